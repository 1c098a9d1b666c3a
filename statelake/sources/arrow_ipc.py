"""Arrow IPC files as a DataFrame, split by record batch."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, types as T

from statelake import schemas
from statelake.sources.files import list_files, open_random, refuse_used, replacing

SLICE_ROWS = 65_536
ARROW_TYPES = {T.StringType: pa.string(), T.BinaryType: pa.binary(), T.LongType: pa.int64(), T.IntegerType: pa.int32()}


def _plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            with open_random(path) as source, pa.ipc.open_file(source) as reader:
                numbers = pa.array(range(reader.num_record_batches), pa.int32())
            yield pa.record_batch([pa.array([path] * len(numbers)), numbers], names=["path", "part"])


def read_arrow(spark: SparkSession, path: str | list[str], schema: T.StructType = schemas.STATE) -> DataFrame:
    """All rows of Arrow files, in the columns and types of `schema`.

    Footers are read first; then every record batch is its own piece of work, so a large file is shared by tasks.
    """
    target = pa.schema([(f.name, ARROW_TYPES[type(f.dataType)]) for f in schema.fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, part in zip(batch.column("path").to_pylist(), batch.column("part").to_pylist()):
                with open_random(name) as source, pa.ipc.open_file(source) as reader:
                    held = pa.Table.from_batches([reader.get_batch(part)]).select(target.names).cast(target)
                    yield from held.to_batches(max_chunksize=SLICE_ROWS)

    files = list_files(spark, path, "*.{arrow,ipc,feather}", required=True).select("path")
    # a number of partitions of its own: the few bytes of a listing would be put into one
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = files.mapInArrow(_plan, "path string, part int").repartition(tasks, "path", "part")
    return parts.mapInArrow(read, schema)


def write_arrow(df: DataFrame, root: str) -> DataFrame:
    """One Arrow file per task, written batch by batch; returns (path, rows). A retried task writes its file again.

    A folder that already has a listing is refused.
    """
    refuse_used(df.sparkSession, f"{root}/_listing")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        path, rows = f"{root}/part_{TaskContext.get().partitionId():06d}.arrow", 0
        with replacing(path) as sink, pa.ipc.new_file(sink, first.schema) as writer:
            for batch in chain([first], batches):
                writer.write_batch(batch)
                rows += batch.num_rows
        yield pa.record_batch([pa.array([path]), pa.array([rows])], names=["path", "rows"])

    listing = f"{root}/_listing"
    df.mapInArrow(write, "path string, rows long").write.mode("overwrite").parquet(listing)
    return df.sparkSession.read.schema("path string, rows long").parquet(listing)
