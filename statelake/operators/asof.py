"""As-of join: the value of a key at the time of another row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from statelake.operators.hot import hot_splits, same, slice_of
from statelake.operators.sizing import fits


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_time: str,
    right_time: str,
    order: Sequence[str] = (),
    direction: str = "backward",
    strict: bool = False,
    tolerance: Column | int | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Every left row with the right row of its key that is the last one at or before its time.

    `strict` leaves out equal times; `direction="forward"` takes the first one at or behind instead. Of right rows of one
    time the greatest (forward: least) in `order` counts, then one fixed by its hash. With a `tolerance` a right row farther away
    than that is none. Left rows without a partner keep nulls, and so do left rows whose key or time is null; right rows
    without key or time never match. The right columns besides `on` must have names of their own.

    Both sides are sorted together by key and time in one shuffle, and the last right row is carried forward over the left
    ones, so neither side is multiplied. A key that holds much of the rows (by a bounded sample) is cut into slices of
    time; the last right row before a slice comes from a table with one row per slice.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"unknown direction {direction}")
    extra = [c for c in right.columns if c not in on]
    clash = set(extra) & set(left.columns)
    if clash:
        raise ValueError(f"right columns need names of their own: {sorted(clash)}")
    back = direction == "backward"
    names = [f"_k{i}" for i in range(len(on))]
    keys = [F.col(f"`{c}`").alias(n) for c, n in zip(on, names)]
    whole = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    value = F.struct(*[F.col(f"`{c}`") for c in extra], F.col(f"`{right_time}`").alias("_rt"))
    rank = F.struct(*[F.col(f"`{c}`") for c in order], F.xxhash64(*[F.col(f"`{c}`") for c in extra]))
    nothing = F.lit(None)

    from_right = right.select(
        *keys, F.col(f"`{right_time}`").alias("_t"), F.lit(1 if strict else 0).alias("_side"), value.alias("_right"),
        rank.alias("_rank"),
    ).dropna(subset=[*names, "_t"])
    types = {f.name: f.dataType for f in from_right.schema.fields}
    from_left = left.select(*keys, F.col(f"`{left_time}`").cast(types["_t"]).alias("_t"), whole.alias("_left"))
    usable = from_left.dropna(subset=[*names, "_t"])
    both = usable.select(
        *names, "_t", F.lit(0 if strict else 1).alias("_side"), nothing.cast(types["_right"]).alias("_right"),
        nothing.cast(types["_rank"]).alias("_rank"), "_left",
    ).unionByName(from_right.withColumn("_left", nothing.cast(usable.schema["_left"].dataType)))

    hot = hot_splits(both.select(*names, "_t"), names, "_t", ranges)
    if hot is not None:
        both = both.join(F.broadcast(hot), names, "left").withColumn("_slice", slice_of(F.col("_t")))
    cut = [] if hot is None else ["_slice"]
    along = (lambda c: F.asc(c)) if back else (lambda c: F.desc(c))
    run = Window.partitionBy(*names, *cut).orderBy(along("_t"), F.asc("_side"), along("_rank"))
    carried = both.withColumn(
        "_found", F.last("_right", ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ).filter("_left is not null")
    if hot is not None:
        best = F.max_by if back else F.min_by
        ends = both.filter("_right is not null and _splits is not null").groupBy(*names, "_slice").agg(
            best("_right", F.struct("_t", "_rank")).alias("_end")
        )
        slices = hot.select(*names, F.explode(F.sequence(F.lit(0), F.size("_splits"))).alias("_slice"))
        before = Window.partitionBy(*names).orderBy(along("_slice")).rowsBetween(Window.unboundedPreceding, -1)
        border = slices.join(ends, [*names, "_slice"], "left").withColumn(
            "_border", F.last("_end", ignorenulls=True).over(before)
        ).drop("_end")
        border = (F.broadcast(border) if fits(border) else border).alias("b")
        carried = carried.alias("c").join(border, same("c", "b", [*names, "_slice"]), "left").select(
            "c._left", "c._t", F.coalesce("c._found", "b._border").alias("_found")
        )
    near = F.lit(True)
    if tolerance is not None:
        bound = tolerance if isinstance(tolerance, Column) else F.lit(tolerance)
        near = F.col("_found._rt") >= F.col("_t") - bound if back else F.col("_found._rt") <= F.col("_t") + bound
    joined = carried.select("_left.*", *[F.when(near, F.col(f"_found.`{c}`")).alias(c) for c in extra])
    alone = from_left.filter(" or ".join(f"{n} is null" for n in [*names, "_t"]))
    none = [nothing.cast(right.schema[c].dataType).alias(c) for c in extra]
    return joined.unionByName(alone.select("_left.*", *none))
