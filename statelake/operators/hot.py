"""Hot groups: found by a bounded sample, cut into slices or spread over a grid."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

#: Sampled rows that stand for one slice of a hot group.
PER_SLICE = 200


def ranges_of(df: DataFrame) -> int:
    """Parts in which a step should be able to run: twice the shuffle partitions."""
    return 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sampled(df: DataFrame, ranges: int) -> tuple[DataFrame, float]:
    """A sample of about PER_SLICE rows per part, and how many sampled rows stand for a part."""
    rows = df.count()
    fraction = min(1.0, PER_SLICE * ranges / max(rows, 1))
    return (df.sample(fraction, seed=7) if fraction < 1 else df), max(1.0, fraction * rows / ranges)


def same(left: str, right: str, names: Sequence[str]) -> Column:
    return reduce(and_, [F.col(f"{left}.{n}") == F.col(f"{right}.{n}") for n in names])


def hot_splits(df: DataFrame, keys: Sequence[str], at: str, ranges: int | None = None) -> DataFrame | None:
    """Keys that hold more than two parts of the rows, with `_splits`: the values of `at` that cut them into parts.

    At most half as many rows as there are parts, since each holds two parts; they come to the driver. None: no key is
    hot. Equal values of `at` are never cut apart.
    """
    ranges = ranges or ranges_of(df)
    drawn, goal = sampled(df.select(*keys, F.col(at).alias("_at")), ranges)
    counted = drawn.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 2 * max(goal, PER_SLICE / 4))
    names = list(keys)
    ordered = drawn.alias("d").join(counted.alias("c"), same("d", "c", names), "left_semi").groupBy(*names).agg(
        F.sort_array(F.collect_list("_at")).alias("_all"), F.count(F.lit(1)).alias("_n")
    )
    places = F.sequence(F.lit(1), F.greatest(F.floor(F.col("_n") / F.lit(goal)), F.lit(1)).cast("int"))
    step = F.transform(places, lambda k: F.get("_all", F.floor(k * F.lit(goal)).cast("int")))
    hot = ordered.select(*names, F.array_distinct(F.array_compact(step)).alias("_splits"))
    found = hot.collect()
    return df.sparkSession.createDataFrame(found, hot.schema) if found else None


def slice_of(at: Column) -> Column:
    """Number of the slice of a value among `_splits` (null: not hot, slice 0)."""
    return F.coalesce(F.size(F.filter("_splits", lambda s: s <= at)), F.lit(0))


def grid_join(left: DataFrame, right: DataFrame, on: Sequence[str], condition: Column, ranges: int | None = None) -> DataFrame:
    """Inner join of `left` (alias l) and `right` (alias r) on equal columns and a condition, hot values spread.

    A value that holds more than two parts of the rows of a side is cut there into pieces by a hash of the whole row. With
    m pieces left and n right it has m * n cells; a left row goes to the n cells of its piece, a right row to m, so a pair
    meets in one cell. The sizes of hot values come from a bounded sample; they only decide how even the tasks are.
    """
    names, parts = list(on), {}
    for side, df in (("_m", left), ("_n", right)):
        drawn, goal = sampled(df.select(*names), ranges or ranges_of(df))
        goal = max(goal, PER_SLICE / 4)
        counted = drawn.groupBy(*names).agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > 2 * goal)
        parts[side] = counted.select(*names, F.ceil(F.col("_c") / F.lit(goal)).cast("int").alias(side))
    wide = parts["_m"].join(parts["_n"], names, "full").select(
        *names, F.coalesce("_m", F.lit(1)).alias("_m"), F.coalesce("_n", F.lit(1)).alias("_n")
    )
    found = wide.collect()  # each value holds two parts of a side: fewer rows than parts
    equal = same("l", "r", names)
    if not found:
        return left.alias("l").join(right.alias("r"), equal & condition)
    cells = F.broadcast(left.sparkSession.createDataFrame(found, wide.schema))

    def spread(df: DataFrame, own: str, other: str) -> DataFrame:
        row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
        marked = df.join(cells, names, "left")
        return marked.withColumn(f"_cell{own}", F.coalesce(F.pmod(row, F.col(own)), F.lit(0)).cast("int")).withColumn(
            f"_cell{other}", F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1))
        ).drop("_m", "_n")

    equal = same("l", "r", [*names, "_cell_m", "_cell_n"])
    return spread(left, "_m", "_n").alias("l").join(spread(right, "_n", "_m").alias("r"), equal & condition)
