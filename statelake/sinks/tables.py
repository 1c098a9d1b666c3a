"""Parquet and JSON sinks (K1, K2, K4-K9)."""

from __future__ import annotations

import time
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from statelake.functions import day_number, render_binary

PARTITIONS = ("chain_id", "date", "topic")


def with_partition_columns(state: DataFrame, chain_id: int) -> DataFrame:
    """K2: chain id, days since 1970 and topic, from the constant, the time and the type."""
    return state.select(
        "*",
        F.lit(chain_id).cast("long").alias("chain_id"),
        day_number(F.col("timestamp")).alias("date"),
        F.col("type").alias("topic"),
    )


def rebalanced(df: DataFrame, *columns: str) -> DataFrame:
    """Rows of a partition together in few files of the advisory size; AQE splits a partition that is too large."""
    return df.hint("rebalance", *columns)


def write_table(
    df: DataFrame,
    path: str,
    partitions: tuple[str, ...] = (),
    mode: str = "append",
    max_records_per_file: int = 0,
    rebalance: bool = True,
    order: tuple[str, ...] = (),
    row_group_bytes: int | None = None,
) -> None:
    """K5/K6: append (or overwrite) as zstd Parquet, optionally with a row limit per file.

    `rebalance=False` saves a shuffle where the rows of a task already belong to few partitions. With `order` rows are
    sorted inside files, so that readers skip row groups (of `row_group_bytes`) by their bounds.
    """
    ready = rebalanced(df, *partitions) if partitions and rebalance else df
    if order:
        ready = ready.sortWithinPartitions(*partitions, *order)
    writer = ready.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", max_records_per_file)
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def write_state(
    state: DataFrame, path: str, chain_id: int, mode: str = "append", max_records_per_file: int = 0,
    row_group_bytes: int | None = None,
) -> None:
    """K1: state rows below chain_id=/date=/topic=, by blob and position inside files."""
    write_table(
        with_partition_columns(state, chain_id), path, PARTITIONS, mode, max_records_per_file,
        order=("blob_index", "position"), row_group_bytes=row_group_bytes,
    )


def write_empty(spark: SparkSession, schema: T.StructType, path: str) -> None:
    """K4: a table with a schema and no rows."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K8: one JSON object per line; null fields are left out."""
    df.write.mode(mode).json(path)


def save_bucketed(df: DataFrame, name: str, buckets: int, keys: tuple[str, ...] = ("key",)) -> None:
    """A base as a bucketed catalogue table: later joins on the keys read it without a shuffle."""
    writer = df.write.mode("overwrite").format("parquet").option("compression", "zstd")
    writer.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)


@dataclass(frozen=True)
class QueryResult:
    """K9: rows of a query for display, binary cells as hex. `complete` is False when `limit` cut them."""

    columns: list[str]
    rows: list[list[Any]]
    row_count: int
    elapsed_ms: float
    complete: bool


def result_of(df: DataFrame, limit: int | None) -> QueryResult:
    """Run `df` and bring at most `limit` rows to the driver, with None all of them."""
    start = time.perf_counter()
    shown = render_binary(df)
    held = (shown if limit is None else shown.limit(limit + 1)).collect()
    elapsed = round((time.perf_counter() - start) * 1000, 3)
    rows = [list(row) for row in held[:limit]]
    return QueryResult(df.columns, rows, len(rows), elapsed, len(rows) == len(held))
