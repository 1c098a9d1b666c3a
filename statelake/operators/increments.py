"""What is new: files against a ledger or against outputs that exist."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from statelake.functions import file_name, stem
from statelake.sources.files import list_files, open_for_read


#: Files up to this size come to their task as one value and are hashed by Spark; larger ones are read in pieces.
WHOLE_BYTES, PIECE_BYTES = 256 << 20, 8 << 20


def _digest_in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            digest = hashlib.sha1()
            with open_for_read(path) as stream:
                while piece := stream.read(PIECE_BYTES):
                    digest.update(piece)
            yield pa.record_batch([pa.array([path]), pa.array([digest.hexdigest()])], names=["path", "sha1"])


def file_digests(
    spark: SparkSession, path: str | list[str], glob: str | None = None, whole_bytes: int = WHOLE_BYTES, recursive: bool = False
) -> DataFrame:
    """(path, name, sha1) of files of any size; the contents are hashed where they are read and go no further. Spark's file
    sources leave out empty files, and so does this.

    Files above `whole_bytes` are streamed from their path by a task, see `sources.files` for the stores that can be opened.
    """
    files = list_files(spark, path, glob, recursive)
    whole = files.filter(F.col("length") <= whole_bytes).select("path", F.sha1("content").alias("sha1"))
    large = files.filter(F.col("length") > whole_bytes).select("path").mapInArrow(_digest_in_pieces, "path string, sha1 string")
    return whole.unionAll(large).select("path", file_name(F.col("path")).alias("name"), "sha1")


def new_files(files: DataFrame, ledger: DataFrame, force: bool = False) -> DataFrame:
    """Files whose name and content are not in the ledger together."""
    return files if force else files.join(ledger.select("name", "sha1").distinct(), ["name", "sha1"], "left_anti")


def without_output(files: DataFrame, outputs: DataFrame, suffix: str | None = None, output_suffix: str | None = None) -> DataFrame:
    """Files with no output of the same stem; both sides have a `path`."""

    def named(path: Column, tail: str | None) -> Column:
        return stem(path, tail).alias("_stem")

    done = outputs.select(named(F.col("path"), output_suffix)).distinct()
    return files.withColumn("_stem", stem(F.col("path"), suffix)).join(done, "_stem", "left_anti").drop("_stem")
