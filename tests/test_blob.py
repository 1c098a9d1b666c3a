"""Blob files: format, bad files, selection by name, content and path as ways to the bytes."""

import gzip
import hashlib
import random
import struct

import pyarrow as pa
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from statelake import schemas
from statelake.plans import registry
from statelake.sources import arrow_ipc, blob, generator, words


def record(key, blob_index, position, code=2):
    return bytes([code, 0]) + b"A" * 20 + key.ljust(32, b"\0") + b"V" * 32 + b"T" * 32 + struct.pack(">II", blob_index, position)


def blob_bytes(records, timestamp=1_700_000_000, magic=b"ZKBL", length=126, count=None):
    rows = len(records) if count is None else count
    head = magic + struct.pack(">HHIQIH", 1, 0, 1, timestamp, rows, length)
    return gzip.compress(head + b"".join(records))


def put(folder, name, content):
    (folder / name).write_bytes(content)


@pytest.fixture(params=["content", "path", "path, decoded twice"])
def how(request, monkeypatch):
    if "twice" in request.param:
        monkeypatch.setattr(blob, "HELD_BYTES", 0)
    return {"by_path": request.param != "content"}


def test_decode(spark, tmp_path, how):
    put(tmp_path, "blob_000001.blob.gz", blob_bytes([record(b"k", 1, i, code=2 if i % 2 else 1) for i in range(500)]))
    put(tmp_path, "blob_000002.blob.gz", blob_bytes([record(b"k", 4_294_967_295, 4_294_967_295)], timestamp=5))
    put(tmp_path, "ignored.bin", b"x")
    df = blob.read_blobs(spark, str(tmp_path), chunk=128, **how)
    assert blob.read_blobs(spark, str(tmp_path), mode="PERMISSIVE", chunk=128, **how).exceptAll(df).count() == 0
    assert df.columns[:5] == ["type", "address", "key", "value", "tx_hash"]
    assert df.schema == schemas.STATE
    assert df.count() == 501
    assert df.groupBy("type").count().orderBy("type").collect() == [("state_diff", 251), ("tx", 250)]
    last = df.filter("timestamp = 5").first()
    assert last["blob_index"] == last["position"] == 4_294_967_295
    assert bytes(last["key"]) == b"k".ljust(32, b"\0") and len(last["address"]) == 20


BAD = {
    "magic": blob_bytes([record(b"k", 1, 1)], magic=b"NOPE"),
    "length": blob_bytes([record(b"k", 1, 1)], length=125),
    "count": blob_bytes([record(b"k", 1, 1)], count=9),
    "cut": blob_bytes([record(bytes([i % 251, i % 7]), 1, i) for i in range(900)])[:-600],
    "damaged": (lambda whole: whole[:3000] + bytes(200) + whole[3200:])(
        blob_bytes([record(random.Random(i).randbytes(32), 1, i) for i in range(900)])
    ),
    "plain": b"not gzip at all",
    "empty": gzip.compress(b""),
}


@pytest.mark.parametrize("name", BAD)
def test_bad_files(spark, tmp_path, how, name):
    put(tmp_path, "blob_000001.blob.gz", blob_bytes([record(b"k", 1, 1)] * 3))
    put(tmp_path, "blob_000002.blob.gz", BAD[name])
    with pytest.raises(PythonException, match="blob_000002"):
        blob.read_blobs(spark, str(tmp_path), **how).collect()
    assert blob.read_blobs(spark, str(tmp_path), mode="PERMISSIVE", **how).count() == 3
    report = blob.blob_report(spark, str(tmp_path), **how)
    assert report.filter("ok").select("rows").collect() == [(3,)]
    with pytest.raises(blob.BlobFormatError, match="blob_000002"):
        blob.check_report(report)
    blob.check_report(report.filter("ok"))


def test_arguments(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        blob.read_blobs(spark, str(tmp_path))
    with pytest.raises(ValueError):
        blob.read_blobs(spark, str(tmp_path), mode="DROPMALFORMED")


def test_selection_by_name(spark, tmp_path):
    for i in (1, 2, 3):
        put(tmp_path, f"blob_{i:06d}.blob.gz", blob_bytes([record(b"k", i, 0)]))

    def indexes(**bounds):
        return sorted(r[0] for r in blob.read_blobs(spark, str(tmp_path), **bounds).select("blob_index").collect())

    assert indexes(max_index=2) == [1, 2]
    assert indexes(min_index=3) == [3]
    assert indexes() == [1, 2, 3]
    put(tmp_path, "extra.blob.gz", blob_bytes([record(b"k", 9, 0)]))
    assert indexes() == [1, 2, 3, 9]
    with pytest.raises(Exception, match="no index in the name of .*extra"):
        indexes(min_index=0)


def test_generate_encode_decode(spark, tmp_path):
    state = generator.generate_state(spark, 700, 3, keyspace=200, seed=4)
    written = blob.write_blobs(state, str(tmp_path), rows_per_file=100)
    assert written.agg(F.sum("rows"), F.max("rows")).first() == (2100, 100)
    files = written.count()
    decoded = blob.read_blobs(spark, str(tmp_path))
    assert decoded.exceptAll(state).count() == 0 and decoded.count() == 2100
    with pytest.raises(FileExistsError):
        blob.write_blobs(state, str(tmp_path), rows_per_file=100)
    again = blob.write_blobs(state, str(tmp_path / "more"), rows_per_file=100)
    assert again.count() == files and blob.read_blobs(spark, str(tmp_path / "more")).count() == 2100


def test_generator_is_seeded_and_hot(spark):
    hot, share = generator.hot_share(1000)
    assert (hot, round(share, 4)) == (50, 0.5128)
    one = generator.generate_state(spark, 20_000, 1, keyspace=1000, seed=1)
    assert one.exceptAll(generator.generate_state(spark, 20_000, 1, keyspace=1000, seed=1)).count() == 0
    assert one.select("value").exceptAll(generator.generate_state(spark, 20_000, 1, keyspace=1000, seed=2).select("value")).count() == 20_000
    counts = [r["count"] for r in one.groupBy("key").count().orderBy(F.desc("count")).collect()]
    assert abs(sum(counts[:hot]) / 20_000 - share) < 0.02
    assert generator.generate_state(spark, 50, 4).select("key").distinct().count() == 200
    assert generator.keyspace_for(8_000_000, 0.5) == 4_000_000


def test_arrow_files(spark, tmp_path):
    state = generator.generate_state(spark, 300, 2, keyspace=50)
    fixed = pa.schema([
        ("type", pa.string()), ("address", pa.binary(20)), ("key", pa.binary(32)), ("value", pa.binary(32)),
        ("tx_hash", pa.binary(32)), ("blob_index", pa.uint32()), ("position", pa.uint32()), ("timestamp", pa.uint64()),
    ])
    with pa.OSFile(str(tmp_path / "a.arrow"), "wb") as sink, pa.ipc.new_file(sink, fixed) as writer:
        writer.write_table(state.toArrow().cast(fixed), max_chunksize=70)
    with pa.OSFile(str(tmp_path / "none.ipc"), "wb") as sink, pa.ipc.new_file(sink, fixed):
        pass
    assert arrow_ipc.read_arrow(spark, str(tmp_path)).exceptAll(state).count() == 0
    assert arrow_ipc.read_arrow(spark, str(tmp_path)).count() == 600
    too_large = pa.table({"timestamp": pa.array([2 ** 63], pa.uint64())})
    with pa.OSFile(str(tmp_path / "big.feather"), "wb") as sink, pa.ipc.new_file(sink, too_large.schema) as writer:
        writer.write_table(too_large)
    schema = schemas._struct(timestamp=schemas._L)
    with pytest.raises(PythonException):
        arrow_ipc.read_arrow(spark, str(tmp_path / "big.feather"), schema).collect()


def test_words(spark, tmp_path):
    content = bytes(range(256)) * 512
    put(tmp_path, "w", content)
    big = words.read_words(spark, str(tmp_path)).orderBy("position").collect()
    assert len(big) == 4096 and all(bytes(r["value"]) == content[32 * i:32 * i + 32] for i, r in enumerate(big))
    little = words.read_words(spark, str(tmp_path), "LE").orderBy("position").first()
    assert bytes(little["value"]) == content[:32][::-1]
    state = words.word_state(words.read_words(spark, str(tmp_path)), 7, 3)
    assert state.columns == ["value", "timestamp", "blob_index", "position"] and state.count() == 4096
    put(tmp_path, "short", b"x" * 100)
    with pytest.raises(Exception, match="131072"):
        words.read_words(spark, str(tmp_path)).collect()


def test_words_of_many_blobs_in_little_endian(spark):
    blobs = {f"b{i}": random.Random(i).randbytes(words.BLOB_BYTES) for i in range(20)}
    rows = spark.createDataFrame([(p, bytearray(c)) for p, c in blobs.items()], "path string, content binary").coalesce(1)
    little = words.split_words(rows, "LE").toArrow().to_pylist()
    assert len(little) == len(blobs) * words.WORDS
    for row in little:
        at = 32 * row["position"]
        assert row["value"] == blobs[row["path"]][at:at + 32][::-1]
    assert words.split_words(rows.limit(0), "LE").count() == 0
    bad = spark.createDataFrame([("p", None), ("q", bytearray(words.BLOB_BYTES + 32))], "path string, content binary")
    with pytest.raises(Exception, match="got 131104: q"):
        words.split_words(bad.filter("path = 'q'"), "LE").collect()
    with pytest.raises(Exception):
        words.split_words(bad.filter("path = 'p'"), "LE").collect()


def test_blob_words_spreads_one_file_over_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(registry, "BLOBS_PER_TASK", 5, raising=False)
    keys = [*range(58), 7, 7]

    def put_suppliers(name, some):
        rows = spark.createDataFrame([(k,) for k in some], "s_suppkey long").coalesce(1)
        rows.write.parquet(str(tmp_path / name / "supplier.parquet"))

    put_suppliers("some", keys)
    hashes = [[hashlib.sha256(f"{k}-{i}".encode()).digest() for k in set(keys)] for i in range(words.WORDS)]
    expected = {(i, "0x" + max(h).hex(), "0x" + max(x[::-1] for x in h).hex()) for i, h in enumerate(hashes)}
    spark.sparkContext.setJobGroup("blob_words", "")
    found = registry.QUERIES["blob_words"](spark, str(tmp_path / "some")).collect()
    status = spark.sparkContext.statusTracker()
    stages = {s: status.getStageInfo(s) for j in status.getJobIdsForGroup("blob_words") for s in status.getJobInfo(j).stageIds}
    spark.sparkContext.setJobGroup("rest", "")
    assert len(found) == words.WORDS and {tuple(r) for r in found} == expected
    tasks = [s.numCompletedTasks for s in stages.values() if s]
    assert tasks.count(12) == 2, tasks  # 60 blobs, 5 in a task, for each byte order
    put_suppliers("none", [])
    assert registry.QUERIES["blob_words"](spark, str(tmp_path / "none")).count() == 0
    put_suppliers("null", [1, None])
    with pytest.raises(Exception):
        registry.QUERIES["blob_words"](spark, str(tmp_path / "null")).collect()


def test_members(spark, tmp_path):
    state = generator.generate_state(spark, 1000, 3, keyspace=100)
    where = str(tmp_path / "m")
    listing = blob.write_blobs(state, where, rows_per_file=700, rows_per_member=64)
    assert listing.agg(F.sum("rows")).first()[0] == 3000 and listing.count() == blob.blob_report(spark, where).count()
    members = spark.read.parquet(f"{where}/_listing")
    assert members.count() > 40 and members.filter("with_header").count() == listing.count()
    rows = sorted(map(tuple, blob.read_members(spark, where, chunk=50).collect()))
    assert rows == sorted(map(tuple, state.collect())) == sorted(map(tuple, blob.read_blobs(spark, where).collect()))
    tasks = blob.read_members(spark, where).select(F.spark_partition_id()).distinct().count()
    assert tasks > listing.count() or tasks >= 6
    moved = tmp_path / "elsewhere"
    (tmp_path / "m").rename(moved)
    assert blob.read_members(spark, str(moved)).count() == 3000
    name = sorted(p for p in moved.iterdir() if p.name.endswith(".gz"))[0]
    name.write_bytes(name.read_bytes()[:-40])
    with pytest.raises(PythonException, match=name.name):
        blob.read_members(spark, str(moved)).count()
