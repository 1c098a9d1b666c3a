"""Last-write-wins: compaction, snapshots as of a point, base plus recent rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from statelake.operators.sizing import fits, measure, within

KEYS = ("key",)
ORDER = ("timestamp", "blob_index", "position")
# rows that agree in the whole order still need one fixed winner
TIES = ("tx_hash", "value")
SECONDS_PER_DAY = 86_400


def _latest_first(order: Sequence[str], ties: Sequence[str]) -> list[Column]:
    return [F.desc(c) for c in (*order, *ties)]


def _newer(left: str, right: str, order: Sequence[str]) -> Column:
    """Row comparison left > right over the order columns; never null, so a null never wins."""
    result = F.lit(False)
    for name in reversed(order):
        a, b = F.col(f"{left}.{name}"), F.col(f"{right}.{name}")
        result = (a > b) | ((a == b) & result)
    return F.coalesce(result, F.lit(False))


def lww(
    df: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, ties: Sequence[str] = TIES
) -> DataFrame:
    """L1: the newest row of every key.

    Catalyst keeps one row per key and task before the only shuffle, so a hot key sends as many rows as there
    are tasks, not as many as it has.
    """
    place = Window.partitionBy(*keys).orderBy(*_latest_first(order, ties))
    return df.withColumn("_rn", F.row_number().over(place)).filter("_rn = 1").drop("_rn")


def lww_max_by(
    df: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, ties: Sequence[str] = TIES
) -> DataFrame:
    """The rows of L1 by aggregation; this form also runs on a stream."""
    newest = F.max_by(F.struct(*df.columns), F.struct(*order, *ties))
    return df.groupBy(*keys).agg(newest.alias("_row")).select("_row.*")


def between(
    df: DataFrame,
    min_timestamp: int | None = None,
    max_timestamp: int | None = None,
    min_blob_index: int | None = None,
    max_blob_index: int | None = None,
    day_column: str | None = None,
) -> DataFrame:
    """Rows inside the given bounds, all inclusive; without bounds all rows.

    `day_column` names a column that holds the day number of the timestamp; where it is a partition column, time
    bounds then skip whole folders.
    """
    if day_column is not None:
        days = [None if t is None else t // SECONDS_PER_DAY for t in (min_timestamp, max_timestamp)]
        df = df if days[0] is None else df.filter(F.col(day_column) >= days[0])
        df = df if days[1] is None else df.filter(F.col(day_column) <= days[1])
    for column, low, high in (
        ("timestamp", min_timestamp, max_timestamp),
        ("blob_index", min_blob_index, max_blob_index),
    ):
        if low is not None:
            df = df.filter(F.col(column) >= low)
        if high is not None:
            df = df.filter(F.col(column) <= high)
    return df


def lww_between(df: DataFrame, *, keys: Sequence[str] = KEYS, **bounds: int | str | None) -> DataFrame:
    """L2: compaction of the rows inside the bounds of `between`; the filter stays below the ranking and reaches the
    scan."""
    return lww(between(df, **bounds), keys)


def as_of(
    df: DataFrame,
    blob_index: int | None = None,
    timestamp: int | None = None,
    keys: Sequence[str] = KEYS,
    day_column: str | None = None,
) -> DataFrame:
    """L3: the state as it was at a blob or at a time."""
    return lww_between(df, keys=keys, max_blob_index=blob_index, max_timestamp=timestamp, day_column=day_column)


def split_window(df: DataFrame, last: int, window: int) -> tuple[DataFrame, DataFrame] | None:
    """L4: rows up to blob `last - window`, and the recent rows behind it; None when the window is too wide."""
    edge = last - window
    if edge < 0:
        return None
    return df.filter(F.col("blob_index") <= edge), df.filter(F.col("blob_index") > edge)


def _same_key(left: str, right: str, keys: Sequence[str], null_safe: bool) -> Column:
    pairs = [(F.col(f"{left}.{k}"), F.col(f"{right}.{k}")) for k in keys]
    return reduce(and_, [a.eqNullSafe(b) if null_safe else a == b for a, b in pairs])


def _few_keys(recent: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """The recent keys when they are measured to fit a broadcast; all of them if that is little, else the distinct.

    One pass measures them and estimates the distinct; these are only counted where the estimate is promising.
    """
    every = recent.select(*keys)
    rows, volume, distinct = measure(every)
    if within(rows, volume):
        return every
    if not within(distinct, 0):
        return None
    return every.distinct() if fits(every.distinct()) else None


def _against_base(
    winners: DataFrame,
    base: DataFrame,
    few: DataFrame | None,
    keys: Sequence[str],
    order: Sequence[str],
    null_safe: bool,
) -> DataFrame:
    """The recent winners that are new or strictly newer than the base row of their key.

    Few recent keys go to the base by broadcast first, so only the base rows they hit are shuffled.
    """
    known = base.select(*keys, *order).alias("b")
    if few is not None:
        known = known.join(F.broadcast(few.alias("w")), _same_key("b", "w", keys, null_safe), "left_semi")
    known = known.withColumn("_in_base", F.lit(True)).alias("b")
    joined = winners.alias("d").join(known, _same_key("d", "b", keys, null_safe), "left")
    return joined.filter(F.col("b._in_base").isNull() | _newer("d", "b", order)).select("d.*")


def delta_winners(recent: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Compaction inside the recent rows."""
    return lww(recent, keys)


def live_count_as_written(
    base: DataFrame, recent: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER
) -> DataFrame:
    """Base keys plus newer or new recent keys. A key updated in the window counts twice by definition.

    Which of two equal rows wins does not change the count, so the winners are a plain aggregation of the order.
    """
    newest = recent.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_order")).select(*keys, "_order.*")
    delta = _against_base(newest, base, _few_keys(recent, keys), keys, order, null_safe=False)
    return base.select(*keys).unionAll(delta.select(*keys)).agg(F.count(F.lit(1)).alias("keys"))


def live_view(
    base: DataFrame,
    recent: DataFrame,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER,
    ties: Sequence[str] = TIES,
) -> DataFrame:
    """One row per key from a compacted base and recent rows; the base keeps its row on equal order.

    Few recent keys: they are broadcast, and the base is read without a shuffle. Many: both sides go into one
    ranking, which shuffles every base row once.
    """
    few = _few_keys(recent, keys)
    if few is not None:
        delta = _against_base(lww(recent, keys, order, ties), base, few, keys, order, null_safe=True)
        # at most one row per recent key, so within the bound just measured
        replaced = F.broadcast(delta.select(*keys).alias("d"))
        kept = base.alias("b").join(replaced, _same_key("b", "d", keys, null_safe=True), "left_anti")
        return kept.unionByName(delta)
    ranked = base.withColumn("_base", F.lit(1)).unionByName(recent.withColumn("_base", F.lit(0)))
    return lww(ranked, keys, order, ("_base", *ties)).drop("_base")


def global_last(df: DataFrame, order: Sequence[str] = ORDER, ties: Sequence[str] = TIES) -> DataFrame:
    """The one newest row of the whole table, as top-1 per task and not as one sorted partition."""
    return df.orderBy(*_latest_first(order, ties)).limit(1)


def key_count(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """How many rows compaction would leave."""
    return df.select(*keys).distinct().agg(F.count(F.lit(1)).alias("unique_keys"))


def last_timestamp(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Newest timestamp per key."""
    return df.groupBy(*keys).agg(F.max("timestamp").alias("ts"))


def duplicate_keys(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keys that occur more than once; empty for a valid snapshot."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
