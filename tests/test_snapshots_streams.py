"""Versioned snapshots and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from statelake import schemas
from statelake.operators import lww as L, sizing
from statelake.sinks.snapshots import SnapshotStore
from statelake.sources import blob, generator
from statelake.streaming import jobs

from test_lww import TEXT, collected, make_rows, newest, overlay


def store_of(spark, path, **options):
    return SnapshotStore(spark, str(path), schema=spark.createDataFrame([], TEXT).schema, **{"buckets": 4, **options})


@pytest.mark.parametrize("merge", ["upsert", "append_delta"])
def test_batches(spark, tmp_path, merge):
    store, rows = store_of(spark, tmp_path), []
    assert store.version() is None and store.read().count() == 0
    expected = {}
    for seed in range(3):
        batch = make_rows(60, seed, hot=False)
        getattr(store, merge)(spark.createDataFrame(batch, TEXT))
        expected = overlay(expected, batch)
        rows.append(sorted(expected.values()))
        assert collected(store.read()) == rows[-1]
    assert [collected(store.read(v)) for v in (1, 2, 3)] == rows
    store.compact()
    assert collected(store.read()) == rows[-1] and L.duplicate_keys(store.read()).count() == 0
    store.expire(2)
    assert store._numbers() == [3, 4] and [collected(store.read(v)) for v in (3, 4)] == [rows[-1]] * 2
    with pytest.raises(ValueError):
        store.read(99)


def test_upsert_keeps_older_on_tie_and_untouched_buckets(spark, tmp_path):
    store = store_of(spark, tmp_path)
    rows = [("tx", "a", f"k{i}", "old", "t", 1, 1, 1) for i in range(40)]
    store.replace(spark.createDataFrame(rows, TEXT))
    store.upsert(spark.createDataFrame([("tx", "a", "k1", "tie", "zzz", 1, 1, 1)], TEXT))
    assert {r["value"] for r in store.read().collect()} == {"old"}
    first = {part[2] for part in store._version(1).parts}
    assert len(first) == 1 and len([p for p in store._version().parts if p[2] not in first]) == 1
    store.upsert(spark.createDataFrame([("tx", "a", "k1", "new", "t", 1, 2, 1)], TEXT))
    assert store.read().filter("value = 'new'").count() == 1 and store.read().count() == 40
    assert store.read(1).filter("value = 'new'").count() == 0


def test_repeated_batch_and_leftovers(spark, tmp_path):
    store = store_of(spark, tmp_path)
    one = spark.createDataFrame([("tx", "a", "k", "1", "t", 1, 1, 1)], TEXT)
    two = spark.createDataFrame([("tx", "a", "k", "2", "t", 1, 1, 2), ("tx", "a", "j", "2", "t", 1, 1, 2)], TEXT)
    assert store.upsert(one, "s", 0) == 1
    assert store.upsert(two, "s", 0) == 1 and store.append_delta(two, "s", 0) == 1
    # a writer died after its data and before its list: nobody reads the data
    store._write_base(two.withColumn("value", F.lit("dead")))
    assert store.read().count() == 1
    assert store.upsert(two, "other", 0) == 2
    assert {r["value"] for r in store.read().collect()} == {"2"}
    assert store.upsert(one, "s", 1) == 3 and store.upsert(one, "other", 0) == 3


@pytest.mark.parametrize("buckets,files", [(4, 8), (16, 16), (3, 24)])
def test_buckets_follow_the_shuffle(spark, tmp_path, buckets, files):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store = store_of(spark, tmp_path, buckets=buckets)
        store.replace(spark.createDataFrame([("tx", "a", f"k{i}", "v", "t", 1, 1, 1) for i in range(500)], TEXT))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert store.read().count() == 500 and len(store.read().inputFiles()) <= files
    assert len(store._version().parts) == buckets


def test_second_writer_fails(spark, tmp_path):
    store = store_of(spark, tmp_path)
    rows = [("tx", "a", f"k{i}", "first", "t", 1, i, 1) for i in range(30)]
    store.replace(spark.createDataFrame(rows, TEXT))
    before, held = store._version(), collected(store.read())
    late = store_of(spark, tmp_path)
    late._version = lambda number=None: before if number is None else SnapshotStore._version(late, number)
    winner = [("tx", "a", "k1", "winner", "t", 1, 99, 9)]
    loser = [("tx", "a", "k1", "loser", "t", 1, 98, 8), ("tx", "a", "new", "loser", "t", 1, 98, 8)]
    assert store.upsert(spark.createDataFrame(winner, TEXT)) == 2
    after = collected(store.read())
    for step in (late.upsert, late.append_delta, late.replace):
        with pytest.raises(FileExistsError):
            step(spark.createDataFrame(loser, TEXT))
    assert collected(store.read(1)) == held and collected(store.read(2)) == collected(store.read()) == after


@pytest.mark.parametrize("seed", range(3))
def test_deltas_and_upserts_agree_on_ties(spark, tmp_path, seed):
    """Few keys and orders, so that most rows tie; every way of merging keeps the row that came first."""
    rng, expected = random.Random(seed), {}
    stores = {way: store_of(spark, tmp_path / way) for way in ("upsert", "delta", "mixed")}
    for batch in range(4):
        rows = [("tx", "a", f"k{rng.randrange(6)}", f"b{batch}", rng.choice("tuv"), 1, rng.randrange(2), 1) for _ in range(5)]
        df = spark.createDataFrame(rows, TEXT)
        expected = overlay(expected, rows)
        stores["upsert"].upsert(df)
        stores["delta"].append_delta(df)
        (stores["mixed"].upsert if batch % 2 else stores["mixed"].append_delta)(df)
        for store in stores.values():
            assert collected(store.read()) == sorted(expected.values())
    stores["delta"].compact()
    assert collected(stores["delta"].read()) == sorted(expected.values())


def test_few_delta_keys_leave_the_base_where_it_is(spark, tmp_path):
    store = store_of(spark, tmp_path)
    store.replace(spark.createDataFrame([("tx", "a", f"k{i}", "v", "t", 1, 1, 1) for i in range(200)], TEXT))
    store.append_delta(spark.createDataFrame([("tx", "a", "k7", "w", "t", 1, 2, 2)], TEXT))
    df = store.read()
    assert df.filter("value = 'w'").count() == 1 and df.count() == 200
    plan = df._jdf.queryExecution().executedPlan().toString()
    kept = plan[plan.index("BroadcastHashJoin"):plan.index("FileScan")]
    assert "LeftAnti" in kept and "Exchange" not in kept


def test_empty_batches(spark, tmp_path):
    store, none = store_of(spark, tmp_path), spark.createDataFrame([], TEXT)
    for step in (store.replace, store.upsert, store.append_delta):
        step(none)
    assert store.compact() == 4 and store.read().count() == 0


def arrivals(spark, path, seed):
    rows = make_rows(400, seed)
    random.Random(seed).shuffle(rows)
    for i in range(4):
        spark.createDataFrame(rows[i::4], TEXT).coalesce(1).write.mode("append").parquet(str(path))
    return rows, spark.readStream.schema(TEXT).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_stream_equals_batch(spark, tmp_path):
    rows, stream = arrivals(spark, tmp_path / "in", 21)
    query = jobs.updates_to(jobs.current_values(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 4
    assert collected(jobs.read_updates(spark, str(tmp_path / "out"))) == sorted(newest(rows).values())


@pytest.mark.parametrize("as_delta", [False, True])
def test_stream_into_snapshots_and_restart(spark, tmp_path, as_delta):
    rows, stream = arrivals(spark, tmp_path / "in", 22)
    store = store_of(spark, tmp_path / "store", buckets=2)

    def run():
        jobs.upsert_into(stream, store, str(tmp_path / "cp"), "s", as_delta).awaitTermination()

    run()
    assert collected(store.read()) == sorted(overlay({}, rows).values())
    assert {k[2]: k[7:] for k in collected(store.read())} == {k[2]: k[7:] for k in newest(rows).values()}
    version = store.version()
    run()
    assert store.version() == version
    late = [("tx", "a", "hot", "late", "t", 0, 0, 0), ("tx", "a", "fresh", "new", "t", 0, 0, 0)]
    spark.createDataFrame(late, TEXT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    values = {r["key"]: r["value"] for r in store.read().collect()}
    assert values["fresh"] == "new" and values["hot"] != "late"


@pytest.mark.parametrize("by_path", [False, True])
def test_catch_up_reads_new_files_once(spark, tmp_path, by_path):
    source = str(tmp_path / "blobs")

    def run():
        stream = jobs.stream_blobs(spark, source, max_files=1, by_path=by_path)
        jobs.catch_up(stream, str(tmp_path / "lake"), str(tmp_path / "cp"), 5).awaitTermination()
        return spark.read.schema(schemas.STATE_PARTITIONED).parquet(str(tmp_path / "lake"))

    first = generator.generate_state(spark, 50, 2)
    blob.write_blobs(first, source)
    assert run().count() == 100 and run().count() == 100
    second = generator.generate_state(spark, 30, 1, seed=9).withColumn("blob_index", F.lit(77).cast("long"))
    blob.write_blobs(second, source + "/tmp2")
    for name in (tmp_path / "blobs/tmp2").glob("*.blob.gz"):
        (tmp_path / "blobs" / ("new_" + name.name)).write_bytes(name.read_bytes())
    lake = run()
    assert lake.count() == 130 and lake.select("chain_id").distinct().first()[0] == 5
    assert lake.select(*schemas.STATE_COLUMNS).exceptAll(first.unionAll(second)).count() == 0
