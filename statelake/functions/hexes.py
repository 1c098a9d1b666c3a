"""Hex text: F1, F2, D5 and the numeric order behind W6."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

SHORT_BYTES = 16


def to_hex(column: Column) -> Column:
    """Binary as 0x-prefixed lower-case hex; null stays null."""
    return F.concat(F.lit("0x"), F.lower(F.hex(column)))


def short_hex(column: Column) -> Column:
    """The first 16 bytes as hex, with an ellipsis when there are more; null becomes empty text."""
    head = to_hex(F.substring(column, 1, SHORT_BYTES))
    return F.coalesce(F.concat(head, F.when(F.octet_length(column) > SHORT_BYTES, "…").otherwise("")), F.lit(""))


def norm_hex(column: Column) -> Column:
    """Lower-case and strip leading zeros behind a lower-case 0x; every other text passes unchanged."""
    text = column.cast("string")
    digits = F.ltrim(F.lower(F.substr(text, F.lit(3))), F.lit("0"))
    return F.when(
        text.startswith("0x"), F.concat(F.lit("0x"), F.when(digits == "", "0").otherwise(digits))
    ).otherwise(text)


def hex_rank(column: Column) -> Column:
    """Sort key that orders normalised hex text by number: 251 bits do not fit any Spark number type."""
    normal = norm_hex(column)
    return F.struct(F.length(normal).alias("digits"), normal.alias("text"))


def numeric_max_hex(column: Column) -> Column:
    """Aggregate: the numerically greatest hex text of a group, normalised."""
    return F.max(hex_rank(column))["text"]


def render_binary(df: DataFrame, render=to_hex) -> DataFrame:
    """Every binary column rendered as text, the others as they are."""
    return df.select(*[
        render(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])
