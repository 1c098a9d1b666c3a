"""Paths and file names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DEFAULT_EXTENSION = ".bin"


def absolute_path(column: Column, base: str) -> Column:
    """Relative paths below `base`; anything with a scheme stays. Dot-dot segments are not resolved."""
    bare = F.regexp_replace(column, r"^(\./)+", "")
    below = F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(bare, "^/+", ""))
    return F.when(bare.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), bare).otherwise(below)


def file_name(column: Column) -> Column:
    """Last path segment."""
    return F.regexp_extract(column, r"([^/]*)$", 1)


def stem(column: Column, suffix: str | None = None) -> Column:
    """File name without `suffix`, or without its last extension."""
    tail = r"\Q" + suffix + r"\E$" if suffix else r"(?<=.)\.[^.]*$"
    return F.regexp_replace(file_name(column), tail, "")


def extension(column: Column, default: str = DEFAULT_EXTENSION) -> Column:
    """Lower-case extension of the path part of a URL, with its dot."""
    path = F.regexp_extract(F.regexp_replace(column, "^([A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", ""), "^[^?#;]*", 0)
    found = F.lower(F.regexp_extract(path, r"[^./][^/]*(\.[^./]*)$", 1))
    return F.when(found == "", default).otherwise(found)


def name_index(column: Column) -> Column:
    """Number after the last underscore of a file name (blob_000012.blob.gz -> 12), null when there is none."""
    return F.regexp_extract(file_name(column), r"_(\d+)(?:\.[^_]*)?$", 1).try_cast("bigint")
