"""Decoded JSON documents: one object, an array of objects or JSON lines per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from statelake.functions import file_name

GLOB = "*.{json,JSON,txt,TXT}"
# what JSON calls white space; Spark's trim alone only knows the blank
_BLANK = " \t\r\n"


def _trimmed(column: Column) -> Column:
    return F.btrim(column, F.lit(_BLANK))


def _own_object(line: Column) -> Column:
    """A line from { to }. When all lines of a text are so, each is a document of its own: a closing brace, a line
    break and an opening brace never follow each other inside one JSON document."""
    return line.startswith("{") & line.endswith("}")


def _parsed(text: Column, schema: T.StructType) -> Column:
    """The document as a struct; text that is not such a document stops the job."""
    return F.from_json(text, schema, {"mode": "FAILFAST"})


def documents_in(texts: DataFrame, schema: T.StructType) -> DataFrame:
    """(src, text) with one whole file per row -> (src, doc) with one object per row."""
    body = texts.select("src", _trimmed(F.col("text")).alias("text")).filter("text <> ''")
    lines = F.filter(F.transform(F.split("text", "\n"), _trimmed), lambda line: line != "")
    listed = F.from_json("text", T.ArrayType(T.StringType()), {"mode": "FAILFAST"})
    parts = (
        F.when(F.col("text").startswith("["), F.filter(listed, lambda item: _trimmed(item).startswith("{")))
        .when(~F.col("text").startswith("{"), lines)
        .when(F.instr("text", "\n") == 0, F.array("text"))
        .when(F.forall(lines, _own_object), lines)
        .otherwise(F.array("text"))
    )
    return body.select("src", F.explode(parts).alias("text")).select("src", _parsed(F.col("text"), schema).alias("doc"))


def _plain(path: Column) -> Column:
    """A metadata path without its percent escapes, as readers take it."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _by_shape(lines: DataFrame) -> tuple[list[str], list[str]]:
    """Paths of files whose every line is an object, and of the others.

    Lines are judged where they are read. Like the scan's own listing, the result is one entry per file.
    """
    line = _trimmed(F.col("value"))
    shapes = lines.groupBy("path").agg(
        F.bool_and((line == "") | _own_object(line)).alias("by_line"), F.bool_or(line != "").alias("filled")
    )
    found: tuple[list[str], list[str]] = ([], [])
    for row in shapes.filter("filled").toLocalIterator():
        found[0 if row["by_line"] else 1].append(row["path"])
    return sorted(found[0]), sorted(found[1])


def read_documents(spark: SparkSession, path: str | list[str], schema: T.StructType, layout: str = "auto") -> DataFrame:
    """(src, doc) of all JSON files below `path`; `src` is the file name.

    Files of JSON lines, which may be very large, are read line by line and split between tasks. Only files that
    hold one object or one array are read whole. Telling them apart is a pass over the text, which a known layout
    ("lines" or "whole" for all files) saves.
    """
    if layout not in ("auto", "lines", "whole"):
        raise ValueError(f"layout {layout!r} is not auto, lines or whole")

    def text(where: str | list[str], whole: bool) -> DataFrame:
        rows = spark.read.option("pathGlobFilter", GLOB).text(where, wholetext=whole)
        return rows.select("value", _plain(F.col("_metadata.file_path")).alias("path"))

    if layout == "auto":
        by_line, whole = _by_shape(text(path, False))
    else:
        by_line, whole = (path, None) if layout == "lines" else (None, path)
    src = file_name(F.col("path")).alias("src")
    found = spark.createDataFrame([], T.StructType([T.StructField("src", T.StringType()), T.StructField("doc", schema)]))
    if by_line:
        line = _trimmed(F.col("value"))
        rows = text(by_line, False).filter(line != "")
        found = found.unionAll(rows.select(src, _parsed(line, schema).alias("doc")))
    if whole:
        found = found.unionAll(documents_in(text(whole, True).select(src, F.col("value").alias("text")), schema))
    return found
