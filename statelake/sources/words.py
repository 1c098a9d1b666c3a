"""Fixed-size blobs as 32-byte words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from statelake.sources.files import list_files

# fixed values: bytes per blob and per word
BLOB_BYTES = 131072
WORD_BYTES = 32
WORDS = BLOB_BYTES // WORD_BYTES

BLOBS_PER_BATCH = 16  # sent back from Python at once


def _reversed_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same blobs, the bytes of every word in reverse."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOBS_PER_BATCH):
            path, content = batch.slice(start, BLOBS_PER_BATCH).columns
            turned = [np.frombuffer(c.as_buffer(), np.uint8).reshape(-1, WORD_BYTES)[:, ::-1].tobytes() for c in content]
            yield pa.record_batch([path, pa.array(turned, content.type)], schema=batch.schema)


def split_words(blobs: DataFrame, endian: str = "BE") -> DataFrame:
    """(path, content) -> (path, position, value): one row per word; a blob of any other size is an error."""
    if endian not in ("BE", "LE"):
        raise ValueError("endian is BE or LE")
    size = F.octet_length("content")
    checked = F.when(size == BLOB_BYTES, F.col("content")).otherwise(
        F.raise_error(F.concat(F.lit(f"blob length must be {BLOB_BYTES} bytes, got "), size, F.lit(": "), "path"))
    )
    whole = blobs.select("path", checked.alias("content"))
    if endian == "LE":
        whole = whole.mapInArrow(_reversed_words, whole.schema)
    starts = F.sequence(F.lit(0), F.lit(WORDS - 1))
    return whole.select("path", "content", F.explode(starts).alias("position")).select(
        "path", "position", F.substring("content", 1 + F.col("position") * WORD_BYTES, F.lit(WORD_BYTES)).alias("value")
    )


def read_words(spark: SparkSession, path: str, endian: str = "BE") -> DataFrame:
    return split_words(list_files(spark, path).select("path", "content"), endian)


def word_state(words: DataFrame, timestamp: int, blob_index: Column | int) -> DataFrame:
    """The four-column toy state of a blob: one row per word."""
    index = F.lit(blob_index) if isinstance(blob_index, int) else blob_index
    return words.select(
        "value", F.lit(timestamp).cast("long").alias("timestamp"),
        index.cast("long").alias("blob_index"), F.col("position").cast("long").alias("position"),
    )
