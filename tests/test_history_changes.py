"""Sketches, changes between versions, histories, publishing, and the keyed stream."""

import json
import random

import pytest
from pyspark.sql import functions as F

from statelake.operators import lww as L
from statelake.sinks.history import HistoryStore
from statelake.sinks.snapshots import SnapshotStore
from statelake.streaming import jobs, keyed

from test_lww import TEXT, collected, make_rows


@pytest.fixture(scope="module")
def schema(spark):
    return spark.createDataFrame([], TEXT).schema


def test_a_list_that_is_not_whole_is_stepped_over(spark, tmp_path, schema):
    store = SnapshotStore(spark, str(tmp_path), schema=schema, buckets=2)
    one = spark.createDataFrame(make_rows(20, 1, hot=False), TEXT)
    assert store.replace(one) == 1
    held = collected(store.read())
    (tmp_path / "versions" / "v=2.json").write_text('{"parts": [')  # by a writer of another kind that died
    (tmp_path / "versions" / ".v=3.dead").write_text('{"parts"')  # by one of this kind
    assert collected(store.read()) == held and store.version() == 1
    with pytest.raises(ValueError, match="not whole"):
        store.read(2)
    assert store.append_delta(spark.createDataFrame(make_rows(20, 2, hot=False), TEXT)) == 3
    assert store.version() == 3 and not [p for p in (tmp_path / "versions").iterdir() if p.name.endswith(".part")]
    store.expire(1)
    assert sorted(p.name for p in (tmp_path / "versions").iterdir()) == ["v=3.json"]
    assert store.read().count() >= len(held)


def test_a_name_that_is_taken_is_not_replaced(spark, tmp_path, schema):
    store = SnapshotStore(spark, str(tmp_path), schema=schema, buckets=2)
    rows = spark.createDataFrame(make_rows(20, 1, hot=False), TEXT)
    before = store._version()
    store.replace(rows)
    text = (tmp_path / "versions" / "v=1.json").read_text()
    with pytest.raises(FileExistsError):
        store._publish(before, [])
    assert (tmp_path / "versions" / "v=1.json").read_text() == text
    assert [p.name for p in (tmp_path / "versions").iterdir()] == ["v=1.json"]


def test_sketches(spark, tmp_path, schema):
    store = SnapshotStore(spark, str(tmp_path), schema=schema, buckets=4, sketches=["timestamp"])
    assert store.key_estimate().collect() == [(0, True)]

    def rows(low, high, stamp):
        return spark.range(low, high).selectExpr(
            "'tx' as type", "'a' as address", "concat('k', id) as key", "'v' as value", "'t' as tx_hash",
            "1L as blob_index", "id as position", f"{stamp} as timestamp",
        )

    store.replace(rows(0, 20_000, "id"))
    store.append_delta(rows(10_000, 25_000, "20000 + id"))
    assert store.key_estimate(1).collect() == [(20_000, True)]
    keys, exact = store.key_estimate().first()
    assert not exact and abs(keys - 25_000) < 0.05 * 25_000
    got = {r["rank"]: r["value"] for r in store.quantiles("timestamp", [0.1, 0.5, 0.9], 1).collect()}
    assert all(abs(got[r] - 20_000 * r) < 0.03 * 20_000 for r in (0.1, 0.5, 0.9))
    store.compact()
    assert store.key_estimate().collect() == [(25_000, True)]
    read = store.key_estimate().inputFiles()
    assert read and all("/sketches/" in name for name in read)
    store.expire(1)
    assert store.key_estimate().collect() == [(25_000, True)]
    with pytest.raises(ValueError, match="not sketched"):
        store.quantiles("position", [0.5])


def test_key_filters(spark, tmp_path, schema):
    store = SnapshotStore(spark, str(tmp_path), schema=schema, buckets=8, sketches=[])

    def rows(low, high):
        return spark.range(low, high).selectExpr(
            "'tx' as type", "'a' as address", "if(id = 5, null, concat('k', id)) as key", "'v' as value", "'t' as tx_hash",
            "1L as blob_index", "id as position", "id as timestamp",
        )

    assert store.maybe_held(rows(0, 10)).count() == 0 and store.live_count(rows(0, 10)).first()[0] == 10
    store.replace(rows(0, 30_000))
    assert store.maybe_held(rows(100, 600)).count() == 500
    assert store.maybe_held(rows(30_000, 60_000)).count() < 30_000 * 0.01
    assert store.maybe_held(rows(5, 6)).count() == 1
    assert store.live_count(rows(29_000, 31_000)).first()[0] == 31_000
    one = store.live_count(rows(7, 8).unionByName(rows(40_000, 40_004)))
    assert one.first()[0] == 30_004
    read = {name.split("/bucket=")[1].split("/")[0] for name in one.inputFiles() if "/data/" in name}
    assert 1 <= len(read) <= 2  # the bucket of the known key, and at most one more by chance
    store.append_delta(rows(29_500, 30_500))
    store.upsert(rows(30_200, 30_300))
    assert store.live_count(rows(0, 10)).first()[0] == 30_500 == store.read().count()


def plain_changes(old, new, keys=(2,)):
    of = [{tuple(r[k] for k in keys): tuple(r) for r in rows} for rows in (old, new)]
    out = []
    for key in of[0].keys() | of[1].keys():
        a, b = of[0].get(key), of[1].get(key)
        if a != b:
            out.append(("insert" if a is None else "delete" if b is None else "update", a, b))
    return sorted(out, key=repr)


def test_changes(spark, tmp_path, schema):
    store = SnapshotStore(spark, str(tmp_path), schema=schema, buckets=8)
    store.replace(spark.createDataFrame(make_rows(60, 1, hot=False), TEXT))
    store.upsert(spark.createDataFrame(make_rows(60, 2, hot=False)[:3], TEXT))
    store.append_delta(spark.createDataFrame(make_rows(60, 3, hot=False)[:5], TEXT))
    store.compact()
    store.replace(spark.createDataFrame(make_rows(60, 1, hot=False)[:40], TEXT))
    held = {v: collected(store.read(v)) for v in range(1, 6)}
    for a, b in ((1, 2), (2, 3), (1, 4), (3, 4), (4, 5), (5, 1), (2, 2)):
        got = sorted(((r["change"], r["before"] and tuple(r["before"]), r["after"] and tuple(r["after"]))
                      for r in store.changes(a, b).collect()), key=repr)
        assert got == plain_changes(held[a], held[b]), (a, b)
    assert store.changes(3, 4).count() == 0
    few = len(store._differing(store._version(1), store._version(2)))
    assert 1 <= few <= 3
    files = store.changes(1, 2).inputFiles()
    assert len({name.split("/bucket=")[1].split("/")[0] for name in files}) == few


def plain_as_of(rows, at):
    best = {}
    for r in rows:
        rank = (r[7], r[5], r[6], r[4], r[3])
        if r[7] <= at and (r[2] not in best or rank > best[r[2]][0]):
            best[r[2]] = (rank, r)
    return sorted((r for _, r in best.values()), key=repr)


def test_history(spark, tmp_path, schema):
    rng = random.Random(3)
    rows = sorted({
        ("tx", "a", rng.choice([f"k{rng.randint(0, 12)}", None]), f"v{i}", "t", rng.randint(0, 5), i % 7, rng.randint(0, 30)) for i in range(150)
    }, key=repr)
    rng.shuffle(rows)
    rows.sort(key=lambda r: r[7] if rng.random() < 0.8 else rng.randint(0, 30))
    store, seen = HistoryStore(spark, str(tmp_path), schema, buckets=3), []
    for low in range(0, 150, 50):
        batch = rows[low:low + 50]
        store.merge(spark.createDataFrame(batch + batch[:2], TEXT), "s", low)
        seen += batch
        for at in (-1, 7, 15, 30):
            got = sorted((tuple(r) for r in store.as_of(at).select(*schema.names).collect()), key=repr)
            assert got == plain_as_of(seen, at), (low, at)
    assert store.merge(spark.createDataFrame(rows[:5], TEXT), "s", 100) == 3
    store.merge(spark.createDataFrame(rows[:5], TEXT))  # offered again: nothing new
    assert store.read().count() == len(rows)
    assert sorted(map(tuple, store.current().collect()), key=repr) == plain_as_of(rows, 99)
    plan = store.as_of(7)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "PushedFilters: [IsNotNull(timestamp)" in plan


def test_newer_batches_do_not_rewrite_closed_rows(spark, tmp_path, schema):
    store = HistoryStore(spark, str(tmp_path), schema, buckets=2)
    for t in range(4):
        store.merge(spark.createDataFrame([("tx", "a", f"k{i}", f"v{t}", "t", 1, t, t) for i in range(20)], TEXT))
    closed = [p for p in store._version().parts if p[0] == "closed"]
    assert len({d for *_, d in closed}) == 3 and set(p for p in store._version(3).parts if p[0] == "closed") <= set(closed)


def test_keyed_stream_emits_changes_alone(spark, tmp_path, schema):
    folder = tmp_path / "in"
    first = [("tx", "a", f"k{i}", "1", "t", 1, i, 5) for i in range(6)] + [("tx", "a", None, "n", None, 1, 1, 5)]
    second = [("tx", "a", "k0", "late", "t", 1, 1, 4), ("tx", "a", "k1", "2", "t", 1, 1, 9), ("tx", "a", "k1", "3", "t", 1, 2, 9),
              first[2], ("tx", "a", "new", "1", "t", 1, 1, 1), ("tx", "a", "s", "old", "t", 1, 1, 1), ("tx", "a", "s2", "up", "t", 1, 1, 9)]
    start = spark.createDataFrame([("tx", "a", "s", "snap", "t", 3, 3, 8), ("tx", "a", "s2", "snap", "t", 3, 3, 8)], TEXT)

    def run(rows):
        spark.createDataFrame(rows, TEXT).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        jobs.updates_to(keyed.changed_values(stream, start), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
        emitted = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out"))
        return {(r["key"], r["value"]) for r in emitted.filter(F.col("batch") == emitted.agg(F.max("batch")).first()[0]).collect()}

    assert run(first) == {(r[2], r[3]) for r in first}
    assert run(second) == {("k1", "3"), ("new", "1"), ("s2", "up")}  # a restart from the checkpoint
    assert jobs.read_updates(spark, str(tmp_path / "out")).count() == 9


def test_keyed_stream_needs_no_setting_of_the_session(spark, tmp_path, schema):
    plain = spark.newSession()
    heap = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"  # Spark's default
    plain.conf.set(jobs.STORE, heap)
    start = plain.createDataFrame([("tx", "a", "s", "snap", "t", 3, 3, 8)], TEXT)
    rows = [("tx", "a", "s", "old", "t", 1, 1, 1), ("tx", "a", "k", "1", "t", 1, 1, 1)]
    plain.createDataFrame(rows, TEXT).write.parquet(str(tmp_path / "in"))
    stream = plain.readStream.schema(schema).parquet(str(tmp_path / "in"))
    jobs.updates_to(keyed.changed_values(stream, start), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    assert [(r["key"], r["value"]) for r in jobs.read_updates(plain, str(tmp_path / "out")).collect()] == [("k", "1")]
    assert plain.conf.get(jobs.STORE) == heap
