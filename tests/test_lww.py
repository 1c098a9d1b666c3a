"""Last-write-wins against brute force, its properties, and the plans it must keep."""

import random

import pytest
from pyspark.sql import functions as F

from statelake import schemas
from statelake.operators import lww as L, sizing
from statelake.sinks.tables import save_bucketed, write_state

TEXT = "type string, address string, key string, value string, tx_hash string, blob_index long, position long, timestamp long"


def make_rows(count, seed, hot=True):
    draw = random.Random(seed)
    rows = []
    for i in range(count):
        # a third of all rows is one key; small ranges give many ties in the order columns
        key = "hot" if hot and draw.random() < 0.34 else f"k{draw.randrange(40)}"
        rows.append((
            "tx", "a", key, f"v{draw.randrange(1000)}", f"t{seed}-{i}", draw.randrange(1, 9), draw.randrange(5), draw.randrange(4)
        ))
    return rows


def order(row):
    return (row[7], row[5], row[6])


def newest(rows):
    best = {}
    for row in rows:
        if row[2] not in best or (*order(row), row[4], row[3]) > (*order(best[row[2]]), best[row[2]][4], best[row[2]][3]):
            best[row[2]] = row
    return best


def overlay(base, recent):
    result = dict(base)
    for key, row in newest(recent).items():
        if key not in result or order(row) > order(result[key]):
            result[key] = row
    return result


def collected(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(params=["broadcast", "shuffle"])
def sides(request, monkeypatch):
    if request.param == "shuffle":
        monkeypatch.setattr(sizing, "MAX_ROWS", 0)
    return request.param


def test_lww_matches_brute_force(spark):
    rows = make_rows(900, 1)
    df = spark.createDataFrame(rows, TEXT).repartition(7)
    expected = sorted(newest(rows).values())
    assert collected(L.lww(df)) == expected
    assert collected(L.lww_max_by(df)) == expected
    assert collected(L.lww(L.lww(df))) == expected


def test_order_of_input_does_not_matter(spark):
    rows = make_rows(300, 2)
    shuffled = rows[:]
    random.Random(0).shuffle(shuffled)
    assert collected(L.lww(spark.createDataFrame(rows, TEXT))) == collected(L.lww(spark.createDataFrame(shuffled, TEXT)))


def test_bounds_are_inclusive(spark):
    rows = make_rows(400, 3)
    df = spark.createDataFrame(rows, TEXT)
    kept = [r for r in rows if 1 <= r[7] <= 2 and 3 <= r[5] <= 6]
    found = L.lww_between(df, min_timestamp=1, max_timestamp=2, min_blob_index=3, max_blob_index=6)
    assert collected(found) == sorted(newest(kept).values())
    assert collected(L.as_of(df, blob_index=4)) == sorted(newest([r for r in rows if r[5] <= 4]).values())
    assert collected(L.lww_between(df)) == sorted(newest(rows).values())


def test_split_window(spark):
    df = spark.createDataFrame(make_rows(200, 4), TEXT)
    assert L.split_window(df, 8, 9) is None
    base, recent = L.split_window(df, 8, 8)
    assert base.count() == 0 and recent.count() == 200
    base, recent = L.split_window(df, 8, 3)
    assert {r[0] for r in recent.select("blob_index").distinct().collect()} == {6, 7, 8}
    assert base.count() + recent.count() == 200


@pytest.mark.parametrize("seed", range(3))
def test_live_view_and_count(spark, sides, seed):
    old, new = make_rows(300, seed, hot=False), make_rows(200, seed + 10)
    new.append(("tx", "a", "only-new", "v", "t", 1, 1, 1))
    base = L.lww(spark.createDataFrame(old, TEXT))
    recent = spark.createDataFrame(new, TEXT)
    current = newest(old)
    assert collected(L.live_view(base, recent)) == sorted(overlay(current, new).values())
    late = {k: r for k, r in newest(new).items() if k not in current or order(r) > order(current[k])}
    assert L.live_count_as_written(base, recent).first()["keys"] == len(current) + len(late)


def test_base_wins_a_tie_and_null_keys_match(spark, sides):
    base = spark.createDataFrame([("tx", "a", "k", "base", "a", 1, 1, 1), ("tx", "a", None, "base", "a", 1, 1, 5)], TEXT)
    recent = spark.createDataFrame([("tx", "a", "k", "new", "z", 1, 1, 1), ("tx", "a", None, "late", "z", 9, 9, 4)], TEXT)
    assert {r["value"] for r in L.live_view(base, recent).collect()} == {"base"}


def test_empty_sides(spark, sides):
    rows = make_rows(50, 5)
    full, none = spark.createDataFrame(rows, TEXT), spark.createDataFrame([], TEXT)
    assert collected(L.live_view(none, full)) == sorted(newest(rows).values())
    assert collected(L.live_view(L.lww(full), none)) == sorted(newest(rows).values())
    assert L.live_count_as_written(none, full).first()["keys"] == len(newest(rows))


def test_compaction_in_steps_is_compaction_at_once(spark):
    rows = make_rows(500, 6)
    df = spark.createDataFrame(rows, TEXT)
    base, recent = L.split_window(df, 8, 3)
    assert collected(L.lww(L.lww(base).unionAll(recent))) == collected(L.lww(df))


def test_counts(spark):
    rows = make_rows(300, 7)
    df = spark.createDataFrame(rows, TEXT)
    assert L.key_count(df).first()["unique_keys"] == len(newest(rows))
    assert L.duplicate_keys(L.lww(df)).count() == 0
    assert L.duplicate_keys(df).filter("key = 'hot'").first()["n"] == sum(r[2] == "hot" for r in rows)
    assert L.global_last(df).first()["tx_hash"] == max(rows, key=lambda r: (*order(r), r[4], r[3]))[4]
    assert dict(L.last_timestamp(df).collect())["hot"] == max(r[7] for r in rows if r[2] == "hot")


# -- plans ----------------------------------------------------------------------------------------------------------


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("state") / "t")
    spark.createDataFrame(make_rows(500, 8), TEXT).selectExpr(
        "type", *[f"cast({c} as binary) as {c}" for c in ("address", "key", "value", "tx_hash")], "blob_index", "position", "timestamp"
    ).write.parquet(path)
    return spark.read.schema(schemas.STATE).parquet(path)


def test_compaction_limits_rows_before_its_only_shuffle(stored):
    text = plan(L.lww(stored))
    assert text.count("Exchange hashpartitioning") == 1
    before = text[text.index("Exchange hashpartitioning"):]
    assert "WindowGroupLimit" in before


def test_bounds_reach_the_scan(stored):
    text = plan(L.lww_between(stored, max_blob_index=4, min_timestamp=1))
    assert "LessThanOrEqual(blob_index,4)" in text and "GreaterThanOrEqual(timestamp,1)" in text


def test_time_bounds_skip_folders(spark, stored, tmp_path):
    state = stored.withColumn("timestamp", F.col("timestamp") * 100_000)
    write_state(state, str(tmp_path / "lake"), 1)
    lake = spark.read.schema(schemas.STATE_PARTITIONED).parquet(str(tmp_path / "lake"))
    found = L.as_of(lake, timestamp=200_000, day_column="date").select(*schemas.STATE_COLUMNS)
    assert found.exceptAll(L.as_of(state, timestamp=200_000)).count() == 0 and found.count() > 30
    assert "PartitionFilters: [isnotnull(date" in plan(found) and "(date#" in plan(found)
    low = L.lww_between(lake, min_timestamp=100_000, day_column="date")
    assert low.select(*schemas.STATE_COLUMNS).exceptAll(L.lww_between(state, min_timestamp=100_000)).count() == 0


def test_counting_reads_keys_only(stored):
    assert "ReadSchema: struct<key:binary>" in plan(L.key_count(stored))


def test_small_delta_does_not_shuffle_the_base(spark, stored):
    base = stored.filter("blob_index <= 6")
    recent = stored.filter("blob_index > 6")
    text = plan(L.live_view(base, recent))
    kept = text.split("LeftAnti")[1].split("BroadcastExchange")[0]
    assert "Exchange hashpartitioning" not in kept


def test_global_last_is_a_top_one_per_task(stored):
    assert "TakeOrderedAndProject(limit=1" in plan(L.global_last(stored))


def test_bucketed_base_is_joined_in_place(spark, stored, monkeypatch):
    monkeypatch.setattr(sizing, "MAX_ROWS", 0)
    save_bucketed(L.lww(stored), "bucketed_base", 8)
    base = spark.table("bucketed_base")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(L.live_count_as_written(base, stored))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    join = text[text.index("SortMergeJoin"):]
    assert join.count("Exchange hashpartitioning") == 1
