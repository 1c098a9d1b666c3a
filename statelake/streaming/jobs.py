"""Streams of state: catch-up ingest, current value per key, upserts.

No watermark anywhere: a key can change at any time, and a row that comes late loses by the order columns alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from statelake.operators.lww import KEYS, ORDER, TIES, lww, lww_max_by
from statelake.session import SETTINGS
from statelake.sinks.snapshots import SnapshotStore
from statelake.sinks.tables import PARTITIONS, with_partition_columns
from statelake.sources.blob import GLOB, decode_files
from statelake.sources.files import FILES

STORE = "spark.sql.streaming.stateStore.providerClass"


def stream_blobs(spark: SparkSession, path: str, max_files: int = 1000, by_path: bool = False) -> DataFrame:
    """Records of blob files as they arrive.

    A file is known by its path and read once; for changed contents under an old name compare hashes (`new_files`).
    `by_path` streams the bytes from storage in the task, for files too large to be one value.
    """
    files = (
        spark.readStream.format("binaryFile")
        .option("pathGlobFilter", GLOB)
        .option("maxFilesPerTrigger", max_files)
        .schema(FILES)
        .load(path)
    )
    return decode_files(files.select("path") if by_path else files.select("path", "content"))


def catch_up(state: DataFrame, out: str, checkpoint: str, chain_id: int) -> StreamingQuery:
    """Append everything that is new to the partitioned state table, then stop. Exactly once by the checkpoint."""
    return (
        with_partition_columns(state, chain_id)
        .writeStream.format("parquet")
        .partitionBy(*PARTITIONS)
        .option("checkpointLocation", checkpoint)
        .option("compression", "zstd")
        .trigger(availableNow=True)
        .start(out)
    )


def current_values(
    state: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, ties: Sequence[str] = TIES
) -> DataFrame:
    """Newest row per key of a stream, for update or complete mode. State is one row per key."""
    return lww_max_by(state, keys, order, ties)


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB where the session has Spark's default store, on the heap.

    `keyed.changed_values` needs more than that store can do. A stream takes the settings of its session when it starts; one
    with a checkpoint keeps the store it began with.
    """
    found = spark.conf.get(STORE)
    if found.endswith(".HDFSBackedStateStoreProvider"):
        spark.conf.set(STORE, SETTINGS[STORE])
    try:
        yield
    finally:
        spark.conf.set(STORE, found)


def updates_to(current: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """T2 in update mode into out/batch=<n>/; a repeated batch replaces its own folder."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with _state_on_disk(current.sparkSession):
        return (
            current.writeStream.outputMode("update")
            .foreachBatch(save)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def read_updates(spark: SparkSession, out: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """The newest emitted row per key of `updates_to`."""
    emitted = spark.read.option("basePath", out).parquet(out)
    return lww(emitted, keys, ("batch",), ()).drop("batch")


def upsert_into(state: DataFrame, store: SnapshotStore, checkpoint: str, name: str, as_delta: bool = True) -> StreamingQuery:
    """Every batch becomes a snapshot version, an appended delta or (as_delta=False) rewritten buckets.

    Snapshots remember the last batch of every stream, so a batch that is repeated after a failure changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            (store.append_delta if as_delta else store.upsert)(held, source=name, batch=number)
        finally:
            held.unpersist()

    return (
        state.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
