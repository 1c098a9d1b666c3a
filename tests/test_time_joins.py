"""As-of and interval joins against loops; plans without nested loops; hot keys and bins cut apart."""

import random

import pytest
from pyspark.sql import functions as F

from statelake.operators.asof import asof_join
from statelake.operators.hot import hot_splits
from statelake.operators.intervals import overlap_join

LEFT, RIGHT = "k string, t long, id long", "k string, rt long, seq long, v string"


def drawn(seed, n, hot=0.4):
    rng = random.Random(seed)

    def key():
        x = rng.random()
        return "hot" if x < hot else None if x < hot + 0.05 else f"k{rng.randint(0, 30)}"

    left = [(key(), rng.choice([None, *range(1, 60)]) if rng.random() < 0.1 else rng.randint(0, 4000), i) for i in range(n)]
    right = [(key(), None if rng.random() < 0.02 else rng.randint(0, 4000) // 3 * 3, i, f"v{i}") for i in range(n)]
    return left, right


def expected(left, right, direction, strict, tolerance):
    out = []
    for k, t, i in left:
        best = None
        for rk, rt, seq, v in right:
            if None in (k, t, rk, rt) or rk != k:
                continue
            if direction == "backward":
                fits = rt < t or (rt == t and not strict)
                rank = (rt, seq)
            else:
                fits = rt > t or (rt == t and not strict)
                rank = (-rt, -seq)
            if fits and (best is None or rank > best[0]):
                best = (rank, rt, seq, v)
        if best and tolerance is not None and abs(best[1] - t) > tolerance:
            best = None
        out.append((k, t, i, *(best[1:] if best else (None, None, None))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("direction, strict, tolerance", [
    ("backward", False, None), ("backward", True, 40), ("forward", False, 25), ("forward", True, None),
])
@pytest.mark.parametrize("ranges", [2, 40])
def test_asof_against_loops(spark, direction, strict, tolerance, ranges):
    left, right = drawn(4, 900)
    rows = asof_join(
        spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["k"], "t", "rt", ["seq"], direction, strict,
        tolerance, ranges,
    )
    assert rows.columns == ["k", "t", "id", "rt", "seq", "v"]
    assert sorted(map(tuple, rows.collect()), key=repr) == expected(left, right, direction, strict, tolerance)


def test_asof_cuts_a_hot_key(spark):
    left, right = drawn(5, 3000)
    df = spark.createDataFrame(left, LEFT)
    hot = hot_splits(df.dropna(), ["k"], "t", 40).collect()
    assert [r.k for r in hot] == ["hot"] and 8 <= len(hot[0]["_splits"]) <= 20
    rows = asof_join(df, spark.createDataFrame(right, RIGHT), ["k"], "t", "rt", ["seq"], ranges=40)
    assert sorted(map(tuple, rows.collect()), key=repr) == expected(left, right, "backward", False, None)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_asof_of_one_time_and_of_nothing(spark):
    left, right = [("a", 5, i) for i in range(2000)], [("a", 5, i, f"v{i}") for i in range(2000)]
    rows = asof_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["k"], "t", "rt", ["seq"], ranges=8)
    assert {(r.id, r.seq) for r in rows.collect()} == {(i, 1999) for i in range(2000)}
    none = asof_join(spark.createDataFrame([], LEFT), spark.createDataFrame([], RIGHT), ["k"], "t", "rt")
    assert none.collect() == []
    alone = asof_join(spark.createDataFrame(left[:3], LEFT), spark.createDataFrame([], RIGHT), ["k"], "t", "rt")
    assert {(r.id, r.v) for r in alone.collect()} == {(0, None), (1, None), (2, None)}
    with pytest.raises(ValueError, match="own"):
        asof_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(left, LEFT), ["k"], "t", "t")


A, B = "g string, s long, e long, a long", "g string, bs long, be long, b long"


def interval_rows(seed, n):
    rng = random.Random(seed)

    def one(i):
        s = rng.choice([rng.randint(-500, 5000), 777])
        length = rng.choice([0, 1, 3, 15, 16, 17, 300, 4000, -1])
        g = rng.choice(["x", "y", None]) if rng.random() < 0.2 else "x"
        return (g, None if rng.random() < 0.02 else s, s + length, i)

    return [one(i) for i in range(n)]


def overlaps(a, b):
    return sorted(
        (x + y[1:] for x in a for y in b
         if None not in x and None not in y and x[0] == y[0] and x[1] <= x[2] and y[1] <= y[2] and x[1] <= y[2] and y[1] <= x[2]),
        key=repr,
    )


@pytest.mark.parametrize("ranges", [2, 60])
def test_overlaps_against_loops(spark, ranges):
    a, b = interval_rows(1, 700), interval_rows(2, 300)
    rows = overlap_join(spark.createDataFrame(a, A), spark.createDataFrame(b, B), ("s", "e"), ("bs", "be"), ["g"], ranges)
    assert sorted(map(tuple, rows.collect()), key=repr) == overlaps(a, b)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_points_in_intervals_with_a_hot_bin(spark):
    points = spark.range(6000).selectExpr("id as p", "timestamp_seconds(if(id % 3 = 0, 1000000, id * 50)) as at")
    spans = spark.range(40).selectExpr(
        "id as span", "timestamp_seconds(id * 9000) as lo", "timestamp_seconds(id * 9000 + pow(id % 6, 5)) as hi"
    ).unionAll(spark.sql("select 99L, timestamp_seconds(999999.5), timestamp_seconds(1000000.25)"))
    rows = overlap_join(points, spans, ("at", "at"), ("lo", "hi"), ranges=50)
    slow = points.join(spans, F.expr("at between lo and hi"))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, slow.collect()))
    assert rows.filter("span = 99").count() == 2000


def test_bounds_of_fractions_and_dates(spark):
    a = spark.createDataFrame([(0.2, 0.4, 1), (0.5, 2.5, 2), (-3.7, -3.6, 3)], "s double, e double, a long")
    b = spark.createDataFrame([(0.45, 0.6, 1), (0.4, 0.4, 2), (-3.65, 9.0, 3)], "bs double, be double, b long")
    assert {(r.a, r.b) for r in overlap_join(a, b, ("s", "e"), ("bs", "be")).collect()} == {(1, 2), (1, 3), (2, 1), (2, 3), (3, 3)}
    days = spark.sql("select date'2020-01-01' as s, date'2020-01-05' as e")
    one = spark.sql("select date'2020-01-05' as d")
    assert overlap_join(days, one, ("s", "e"), ("d", "d")).count() == 1
