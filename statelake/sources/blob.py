"""Blob files (`*.blob.gz`): scan, validation, per-file report and writer."""

from __future__ import annotations

import gzip
import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from statelake import schemas
from statelake.functions import name_index
from statelake.sources.files import list_files, open_for_read, open_random, refuse_used, replacing

# fixed values of the file format; all numbers are big-endian
MAGIC = b"ZKBL"
RECORD_BYTES = 126
STATE_DIFF_CODE = 2
HEADER = np.dtype([
    ("magic", "V4"), ("version", ">u2"), ("flags", ">u2"), ("batch", ">u4"),
    ("timestamp", ">u8"), ("rows", ">u4"), ("record_bytes", ">u2"),
])
RECORD = np.dtype([
    ("type", "u1"), ("pad", "u1"), ("address", "V20"), ("key", "V32"), ("value", "V32"),
    ("tx_hash", "V32"), ("blob_index", ">u4"), ("position", ">u4"),
])

CHUNK_ROWS = 200_000
#: What a written folder knows of its files: a row per gzip member.
LISTING = "path string, rows long, start long, timestamp long, with_header boolean"
LISTING_COLUMNS = [part.split()[0] for part in LISTING.split(", ")]
GLOB = "*.blob.gz"
# with mode PERMISSIVE the rows of a file are held until its end is known to be good; files that decode to more are
# decompressed twice instead, with the same result
HELD_BYTES = 128 << 20

ARROW_STATE = pa.schema([
    ("type", pa.string()), ("address", pa.binary()), ("key", pa.binary()), ("value", pa.binary()),
    ("tx_hash", pa.binary()), ("blob_index", pa.int64()), ("position", pa.int64()), ("timestamp", pa.int64()),
])
ARROW_REPORT = pa.schema([
    ("path", pa.string()), ("ok", pa.bool_()), ("rows", pa.int64()), ("seconds", pa.float64()), ("error", pa.string()),
])


class BlobFormatError(ValueError):
    """A blob file that breaks the format."""


def _read_header(stream) -> tuple[int, int]:
    raw = stream.read(HEADER.itemsize)
    if raw[: len(MAGIC)] != MAGIC:
        raise BlobFormatError("wrong magic")
    if len(raw) < HEADER.itemsize:
        raise BlobFormatError("truncated header")
    head = np.frombuffer(raw, HEADER)[0]
    if head["record_bytes"] != RECORD_BYTES:
        raise BlobFormatError(f"record length {head['record_bytes']} instead of {RECORD_BYTES}")
    if head["timestamp"] >= 1 << 63:
        raise BlobFormatError("timestamp does not fit a signed 64-bit integer")
    return int(head["timestamp"]), int(head["rows"])


def _chunks(stream, rows: int, chunk: int) -> Iterator[np.ndarray]:
    while rows:
        take = min(rows, chunk)
        try:
            raw = stream.read(take * RECORD_BYTES)
        except (EOFError, OSError, zlib.error) as cause:
            raise BlobFormatError(f"broken gzip stream: {cause}") from cause
        if len(raw) < take * RECORD_BYTES:
            raise BlobFormatError("truncated records")
        yield np.frombuffer(raw, RECORD)
        rows -= take


def _binary(column: np.ndarray) -> pa.Array:
    width = column.dtype.itemsize
    offsets = np.arange(len(column) + 1, dtype=np.int32) * width
    data = np.ascontiguousarray(column)
    return pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _to_batch(records: np.ndarray, timestamp: int) -> pa.RecordBatch:
    names = pa.array(["tx", "state_diff"])
    kinds = names.take(pa.array((records["type"] == STATE_DIFF_CODE).astype(np.int8)))
    return pa.record_batch([
        kinds, _binary(records["address"]), _binary(records["key"]), _binary(records["value"]),
        _binary(records["tx_hash"]), pa.array(records["blob_index"].astype(np.int64)),
        pa.array(records["position"].astype(np.int64)), pa.array(np.full(len(records), timestamp, np.int64)),
    ], schema=ARROW_STATE)


def _open(path: str, content: pa.Buffer | None):
    raw = open_for_read(path) if content is None else pa.BufferReader(content)
    return gzip.GzipFile(fileobj=raw, mode="rb")


def _decode_file(path: str, content: pa.Buffer | None, chunk: int) -> Iterator[pa.RecordBatch]:
    try:
        with _open(path, content) as stream:
            timestamp, rows = _read_header(stream)
            for records in _chunks(stream, rows, chunk):
                yield _to_batch(records, timestamp)
    except (BlobFormatError, EOFError, gzip.BadGzipFile, zlib.error) as cause:
        raise BlobFormatError(f"{path}: {cause}") from cause


def file_timestamp(path: str) -> int:
    """The timestamp in the header of a file, which all its rows have."""
    try:
        with _open(path, None) as stream:
            return _read_header(stream)[0]
    except (BlobFormatError, EOFError, gzip.BadGzipFile, zlib.error) as cause:
        raise BlobFormatError(f"{path}: {cause}") from cause


def decode_path(path: str, skip_bad: bool = False, chunk: int = CHUNK_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of one file, opened by its path inside a task; with `skip_bad` a file with a fault has none."""
    return (_decode_good if skip_bad else _decode_file)(path, None, chunk)


def _check_file(path: str, content: pa.Buffer | None, chunk: int) -> tuple[int, str | None]:
    rows = 0
    try:
        with _open(path, content) as stream:
            _, expected = _read_header(stream)
            for records in _chunks(stream, expected, chunk):
                rows += len(records)
    except (BlobFormatError, EOFError, gzip.BadGzipFile, zlib.error) as cause:
        return rows, str(cause)
    return rows, None


def _each_file(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Buffer | None]]:
    for batch in batches:
        contents = batch.column("content") if "content" in batch.schema.names else None
        for i, path in enumerate(batch.column("path").to_pylist()):
            yield path, None if contents is None else contents[i].as_buffer()


def _decode_good(path: str, content: pa.Buffer | None, chunk: int) -> Iterator[pa.RecordBatch]:
    """The rows of a file without fault, or none."""
    held, size = [], 0
    try:
        for batch in _decode_file(path, content, chunk):
            held.append(batch)
            size += batch.nbytes
            if size > HELD_BYTES:
                break
        else:
            yield from held
            return
    except BlobFormatError:
        return
    held.clear()
    if _check_file(path, content, chunk)[1] is None:
        yield from _decode_file(path, content, chunk)


def _decoder(chunk: int, skip_bad: bool) -> Callable:
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, content in _each_file(batches):
            yield from (_decode_good if skip_bad else _decode_file)(path, content, chunk)

    return decode


def _reporter(chunk: int) -> Callable:
    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, content in _each_file(batches):
            start = time.perf_counter()
            rows, error = _check_file(path, content, chunk)
            spent = time.perf_counter() - start
            yield pa.RecordBatch.from_pylist(
                [{"path": path, "ok": error is None, "rows": rows, "seconds": spent, "error": error}], ARROW_REPORT
            )

    return report


def _over_files(files: DataFrame, step: Callable, schema, by_path: bool) -> DataFrame:
    return files.select("path", *[] if by_path else ["content"]).mapInArrow(step, schema)


def read_blobs(
    spark: SparkSession,
    path: str | list[str],
    mode: str = "FAILFAST",
    chunk: int = CHUNK_ROWS,
    min_index: int | None = None,
    max_index: int | None = None,
    by_path: bool = False,
) -> DataFrame:
    """All records of all blob files below `path`, one task per file (gzip cannot be split).

    mode FAILFAST stops at a bad file; PERMISSIVE leaves bad files out whole, see `blob_report` for them.
    min_index / max_index pick files by the number in their name (S4), inclusive.
    Spark's reader brings every file to its task as one value (2 GB at most, else it fails and names the file); with
    `by_path` tasks stream every file from its path themselves, see `sources.files` for the stores they can open.
    """
    if mode not in ("FAILFAST", "PERMISSIVE"):
        raise ValueError(f"mode {mode!r} is not FAILFAST or PERMISSIVE")
    files = list_files(spark, path, GLOB, required=True)
    files = select_by_name_index(files, min_index, max_index)
    return _over_files(files, _decoder(chunk, mode == "PERMISSIVE"), schemas.STATE, by_path)


def decode_files(files: DataFrame, chunk: int = CHUNK_ROWS) -> DataFrame:
    """S1 over a listing (batch or stream) of `path`, and `content` unless the tasks shall open the paths themselves."""
    return files.mapInArrow(_decoder(chunk, False), schemas.STATE)


def blob_report(
    spark: SparkSession, path: str | list[str], chunk: int = CHUNK_ROWS, by_path: bool = False
) -> DataFrame:
    """D11 and the error side of S2: one row per file with outcome, rows and seconds."""
    return _over_files(list_files(spark, path, GLOB, required=True), _reporter(chunk), schemas.BLOB_REPORT, by_path)


def check_report(report: DataFrame) -> None:
    """Fail when a file of the report failed, naming the first few."""
    bad = report.filter(~F.col("ok")).select("path", "error").orderBy("path").take(5)
    if bad:
        raise BlobFormatError("; ".join(f"{r['path']}: {r['error']}" for r in bad))


def select_by_name_index(files: DataFrame, min_index: int | None = None, max_index: int | None = None) -> DataFrame:
    """Files whose name carries an index inside the bounds (inclusive); without bounds all files.

    With a bound, a file without a number in its name is an error that names it.
    """
    unknown = F.raise_error(F.concat(F.lit("no index in the name of "), F.col("path"))).cast("long")
    number = F.coalesce(name_index(F.col("path")), unknown)
    if min_index is not None:
        files = files.filter(number >= min_index)
    if max_index is not None:
        files = files.filter(number <= max_index)
    return files


def _pieces(records: list[np.ndarray], size: int) -> Iterator[list[np.ndarray]]:
    """The records in lists of `size` rows."""
    piece, room = [], size
    for part in records:
        while len(part):
            piece.append(part[:room])
            room, part = room - len(piece[-1]), part[room:]
            if not room:
                yield piece
                piece, room = [], size
    if piece:
        yield piece


def _encoder(root: str, rows_per_file: int, rows_per_member: int | None) -> Callable:
    def pack(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(batch.num_rows, RECORD)
        codes = pc.equal(batch.column("type"), "state_diff").to_numpy(zero_copy_only=False)
        out["type"] = np.where(codes, STATE_DIFF_CODE, 1)
        for name in ("address", "key", "value", "tx_hash"):
            fixed = batch.column(name).cast(pa.binary(RECORD[name].itemsize))
            size = RECORD[name].itemsize
            raw = np.frombuffer(fixed.buffers()[1], f"V{size}")
            out[name] = raw[fixed.offset:fixed.offset + len(fixed)]
        for name in ("blob_index", "position"):
            out[name] = batch.column(name).to_numpy()
        return out

    def write(part: int, number: int, timestamp: int, records: list[np.ndarray]) -> pa.RecordBatch:
        """One file; its members are gzip streams one behind the other, which readers of gzip take for one."""
        blob, rows = int(records[0]["blob_index"][0]), sum(map(len, records))
        head = np.array([(MAGIC, 1, 0, blob, timestamp, rows, RECORD_BYTES)], HEADER)
        path = f"{root}/blob_{part:05d}-{number:06d}_{blob:06d}.blob.gz"
        members = []
        with replacing(path) as raw:
            for piece in _pieces(records, rows_per_member or rows):
                members.append((path, sum(map(len, piece)), raw.tell(), timestamp, not members))
                with gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=1, mtime=0) as stream:
                    if members[-1][-1]:
                        stream.write(head.tobytes())
                    for part_of in piece:
                        stream.write(part_of.tobytes())
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*members), types)], names=LISTING_COLUMNS)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, pending, current = TaskContext.get().partitionId(), 0, [], None
        for batch in batches:
            records, stamps = pack(batch), batch.column("timestamp").to_numpy()
            moved = (np.diff(stamps) != 0) | (np.diff(records["blob_index"].astype(np.int64)) != 0)
            edges = [0, *(np.flatnonzero(moved) + 1), len(records)] if len(records) else []
            for low, high in zip(edges, edges[1:]):
                group = (int(stamps[low]), int(records["blob_index"][low]))
                while low < high:
                    held = sum(map(len, pending))
                    if pending and (group != current or held == rows_per_file):
                        number += 1
                        yield write(part, number, current[0], pending)
                        pending, held = [], 0
                    take = min(high - low, rows_per_file - held)
                    pending.append(records[low:low + take])
                    current, low = group, low + take
        if pending:
            yield write(part, number + 1, current[0], pending)

    return encode


def write_blobs(state: DataFrame, root: str, rows_per_file: int = 500_000, rows_per_member: int | None = None) -> DataFrame:
    """Write binary state rows as blob files and return (path, rows) of what was written.

    A file has one timestamp, one blob index (also in its name) and at most `rows_per_file` rows. A blob of more rows
    is counted first and spread by a hash of its content, so a hot blob is shared by many tasks; the full order inside
    a task makes a retried task write the same files again. A folder that already has a listing is refused. With
    `rows_per_member` a file is several gzip members, whose places the listing holds, see `read_members`; every reader of
    blob files reads them as before.
    """
    spark = state.sparkSession
    refuse_used(spark, f"{root}/_listing")
    slices = state.groupBy("blob_index").agg(F.ceil(F.count(F.lit(1)) / rows_per_file).alias("_slices"))
    sized = state.join(slices, "blob_index", "left")
    spread = F.pmod(F.xxhash64("tx_hash", "position", "value"), F.col("_slices"))
    ready = sized.withColumn("_slice", spread).repartition("blob_index", "_slice").sortWithinPartitions(
        "timestamp", "blob_index", "position", "tx_hash", "value", "key", "address", "type"
    ).select(*schemas.STATE_COLUMNS)
    ready.mapInArrow(_encoder(root, rows_per_file, rows_per_member), LISTING).write.mode("overwrite").parquet(f"{root}/_listing")
    members = spark.read.schema(LISTING).parquet(f"{root}/_listing")
    return members.select("path", "rows") if rows_per_member is None else members.groupBy("path").agg(F.sum("rows").alias("rows"))


def read_members(spark: SparkSession, root: str, chunk: int = CHUNK_ROWS) -> DataFrame:
    """All records of a folder that `write_blobs` made, one piece of work per gzip member, so that a large file is shared.

    Members are found by the listing of the folder, which may have been moved since; the files are opened by the tasks.
    """
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                path = f"{root.rstrip('/')}/{row['path'].rsplit('/', 1)[1]}"
                try:
                    with open_random(path) as source:
                        source.seek(row["start"])
                        with gzip.GzipFile(fileobj=source, mode="rb") as stream:
                            if row["with_header"]:
                                _read_header(stream)
                            for records in _chunks(stream, row["rows"], chunk):
                                yield _to_batch(records, row["timestamp"])
                except (BlobFormatError, EOFError, gzip.BadGzipFile, zlib.error) as cause:
                    raise BlobFormatError(f"{path} at {row['start']}: {cause}") from cause

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    members = spark.read.schema(LISTING).parquet(f"{root.rstrip('/')}/_listing")
    # a number of partitions of its own: the few bytes of a listing would be put into one
    return members.repartition(parts, "path", "start").mapInArrow(decode, schemas.STATE)
