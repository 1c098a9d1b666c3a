"""Blob and Arrow files as sources for `spark.read.format`, `readStream` and SQL.

    register(spark)
    spark.read.format("zkbl").load("/data/blobs").filter("blob_index >= 1000")
    spark.sql("create temporary view blobs using zkbl options (path '/data/blobs')")
    spark.readStream.format("zkbl").load("/data/blobs")

A blob file is one partition (gzip cannot be split), an Arrow file one per group of record batches. Comparisons of whole
numbers with blob_index, position and timestamp are pushed into the source: files whose name carries their blob index are
not opened where it is out of bounds, files whose header has another timestamp not decompressed, and rows left out before they
reach Spark. The driver lists files, as Spark's own file sources do; tasks open paths themselves, see `sources.files` for
the stores they can open.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from fnmatch import fnmatch

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import SparkSession, types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition,
    IsNotNull, LessThan, LessThanOrEqual,
)

from statelake import schemas
from statelake.sources import blob
from statelake.sources.arrow_ipc import ARROW_TYPES, SLICE_ROWS
from statelake.sources.files import open_random, resolve

#: Names that `write_blobs` gives: their last number is the blob index of all rows.
_OWN_NAME = re.compile(r"/blob_\d+-\d+_(\d+)\.blob\.gz$")
_COMPARE = {
    EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less,
    LessThanOrEqual: pc.less_equal,
}
NUMBERS = ("blob_index", "position", "timestamp")


def register(spark: SparkSession) -> None:
    """Make the formats `zkbl` and `arrowfile` known to a session, and let filters reach them."""
    for source in (BlobSource, ArrowSource):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def files_below(path: str, patterns: Sequence[str]) -> list[tuple[str, int]]:
    """(path, nanoseconds of change) of a file, or of the matching files of a folder, in the order of their paths."""
    system, name = resolve(path)
    info = system.get_file_info(name)
    if info.type == pafs.FileType.File:
        found = [info]
    elif info.type == pafs.FileType.Directory:
        below = system.get_file_info(pafs.FileSelector(name))
        found = [i for i in below if i.type == pafs.FileType.File and any(fnmatch(i.base_name, p) for p in patterns)
                 and not i.base_name.startswith((".", "_"))]
    else:
        raise FileNotFoundError(f"there is no {path}")
    scheme = path[: -len(name)] if path.endswith(name) else ""
    return sorted((scheme + i.path, i.mtime_ns or 0) for i in found)


class Pushed:
    """Comparisons of number columns, all of which hold for the rows that stay."""

    def __init__(self) -> None:
        self.held: list[tuple[type, str, object]] = []

    def take(self, filters: list[Filter], columns: Sequence[str]) -> Iterator[Filter]:
        """Keep what can be decided here; yield the rest."""
        for one in filters:
            column = one.attribute[0] if len(getattr(one, "attribute", ())) == 1 else None
            values = one.value if isinstance(one, In) else (getattr(one, "value", None),)
            if column in columns and isinstance(one, IsNotNull):
                self.held.append((IsNotNull, column, ()))
            elif column in columns and (type(one) in _COMPARE or isinstance(one, In)) and values and all(
                isinstance(v, int) and not isinstance(v, bool) for v in values
            ):
                self.held.append((type(one), column, tuple(values)))
            else:
                yield one

    def _mask(self, kind: type, column, values: tuple):
        if kind is IsNotNull:
            return pc.is_valid(column)
        if kind is In:
            return pc.is_in(column, pa.array(values, pa.int64()))
        return _COMPARE[kind](column, pa.scalar(values[0], pa.int64()))

    def may(self, column: str, value: int) -> bool:
        """Whether rows with this value can stay."""
        one = pa.array([value], pa.int64())
        return all(self._mask(k, one, v)[0].as_py() for k, c, v in self.held if c == column)

    def rows(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        for kind, column, values in self.held:
            batch = batch.filter(self._mask(kind, batch.column(column), values))
        return batch


class Piece(InputPartition):
    """A file, and of an Arrow file some of its record batches."""

    def __init__(self, path: str, low: int = 0, high: int | None = None) -> None:
        super().__init__((path, low, high))
        self.path, self.low, self.high = path, low, high


# -- blob files -------------------------------------------------------------------------------------------------------


class BlobSource(DataSource):
    """Options: path; mode (FAILFAST, or PERMISSIVE to leave bad files out whole); glob (`*.blob.gz`)."""

    @classmethod
    def name(cls) -> str:
        return "zkbl"

    def schema(self) -> T.StructType:
        return schemas.STATE

    def _reader(self):
        mode = self.options.get("mode", "FAILFAST")
        if mode not in ("FAILFAST", "PERMISSIVE"):
            raise ValueError(f"mode {mode!r} is not FAILFAST or PERMISSIVE")
        return self.options["path"], [self.options.get("glob", blob.GLOB)], mode == "PERMISSIVE"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return BlobReader(*self._reader())

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return BlobStreamReader(*self._reader(), int(self.options.get("settleSeconds", "2")))


def _blob_rows(path: str, skip_bad: bool, pushed: Pushed) -> Iterator[pa.RecordBatch]:
    try:
        stamp = blob.file_timestamp(path)
    except blob.BlobFormatError:
        if skip_bad:
            return
        raise
    if not pushed.may("timestamp", stamp):
        return
    for batch in blob.decode_path(path, skip_bad):
        yield pushed.rows(batch)


class BlobReader(DataSourceReader):
    def __init__(self, path: str, globs: list[str], skip_bad: bool) -> None:
        self.path, self.globs, self.skip_bad, self.pushed = path, globs, skip_bad, Pushed()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        yield from self.pushed.take(filters, NUMBERS)

    def partitions(self) -> list[Piece]:
        out = []
        for path, _ in files_below(self.path, self.globs):
            own = _OWN_NAME.search(path)
            if own is None or self.pushed.may("blob_index", int(own[1])):
                out.append(Piece(path))
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, Piece):  # no file is left: Spark asks for one empty partition
            yield from _blob_rows(partition.path, self.skip_bad, self.pushed)


class BlobStreamReader(DataSourceStreamReader):
    """Files in the order of (time of change, path). A file counts once it is `settleSeconds` old, so that one that got its
    name late, with an older time, is not passed over; a file with a time before the last one read is not read."""

    def __init__(self, path: str, globs: list[str], skip_bad: bool, settle: int) -> None:
        self.path, self.globs, self.skip_bad, self.settle = path, globs, skip_bad, settle

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def _settled(self) -> list[tuple[int, str]]:
        import time

        limit = time.time_ns() - self.settle * 10**9
        return sorted((changed, path) for path, changed in files_below(self.path, self.globs) if changed <= limit)

    def latestOffset(self) -> dict:
        last = max(self._settled(), default=None)
        return self.initialOffset() if last is None else {"time": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        low, high = ((o["time"], o["path"]) for o in (start, end))
        found = [f for f in sorted((c, p) for p, c in files_below(self.path, self.globs)) if low < f <= high]
        return [Piece(path) for _, path in found]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, Piece):
            yield from _blob_rows(partition.path, self.skip_bad, Pushed())

    def commit(self, end: dict) -> None:
        pass


# -- Arrow files ------------------------------------------------------------------------------------------------------


class ArrowSource(DataSource):
    """Options: path; batchesPerTask (16). The columns are those of state, or of a schema given to the reader."""

    @classmethod
    def name(cls) -> str:
        return "arrowfile"

    def schema(self) -> T.StructType:
        return schemas.STATE

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ArrowReader(self.options["path"], schema, int(self.options.get("batchesPerTask", "16")))


class ArrowReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, each: int) -> None:
        self.path, self.fields, self.each, self.pushed = path, [(f.name, type(f.dataType)) for f in schema.fields], each, Pushed()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        yield from self.pushed.take(filters, [name for name, kind in self.fields if kind is T.LongType])

    def partitions(self) -> list[Piece]:
        out = []
        for path, _ in files_below(self.path, ["*.arrow", "*.ipc", "*.feather"]):
            with open_random(path) as source, pa.ipc.open_file(source) as reader:
                count = reader.num_record_batches
            out += [Piece(path, low, min(low + self.each, count)) for low in range(0, count, self.each)]
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Piece):
            return
        target = pa.schema([(name, ARROW_TYPES[kind]) for name, kind in self.fields])
        with open_random(partition.path) as source, pa.ipc.open_file(source) as reader:
            for part in range(partition.low, partition.high):
                held = pa.Table.from_batches([reader.get_batch(part)]).select(target.names).cast(target)
                for batch in held.to_batches(max_chunksize=SLICE_ROWS):
                    yield self.pushed.rows(batch)
