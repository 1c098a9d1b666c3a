"""Interval joins by time bins of several widths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from statelake.operators.hot import grid_join


def _position(column: Column, kind: T.DataType) -> Column:
    """A whole number that grows with the value: microseconds of times, days of dates, the floor of numbers.

    Times without a zone count in seconds by their fields, as a zone would let them jump twice a year.
    """
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.TimestampNTZType):
        days = F.unix_date(column.cast("date")).cast("long")
        return ((days * 24 + F.hour(column)) * 60 + F.minute(column)) * 60 + F.second(column)
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("long")
    return F.floor(column).cast("long")


def _levelled(df: DataFrame, start: str, end: str, on: Sequence[str]) -> DataFrame:
    """All columns as one struct, keys, first and last position, and the level: bins of 4^level hold the interval in two."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    low, high = (_position(F.col(f"`{c}`"), kinds[c]) for c in (start, end))
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(on)],
        F.col(f"`{start}`").alias("_from"), F.col(f"`{end}`").alias("_to"), low.alias("_low"), high.alias("_high"),
    ).dropna(subset=[*[f"_k{i}" for i in range(len(on))], "_low", "_high"]).filter("_from <= _to")
    return rows.withColumn("_level", F.ceil(F.length(F.bin(F.col("_high") - F.col("_low"))) / 2).cast("int"))


def _binned(rows: DataFrame, levels: Column | None) -> DataFrame:
    """A row per bin that the interval meets, at its own level or at each of the given ones."""
    at = rows.withColumn("_bin_level", F.col("_level") if levels is None else F.explode(levels))
    width = 2 * F.col("_bin_level")
    first, last = F.call_function("shiftright", "_low", width), F.call_function("shiftright", "_high", width)
    return at.withColumn("_bin", F.explode(F.sequence(first, last)))


def overlap_join(
    left: DataFrame, right: DataFrame, left_bounds: tuple[str, str], right_bounds: tuple[str, str], on: Sequence[str] = (),
    ranges: int | None = None,
) -> DataFrame:
    """Pairs of rows with equal `on` whose closed intervals [start, end] have a point in common; each pair once.

    A point is an interval whose two bounds are one column. Rows with a null bound or key, or that end before they start,
    have no partners. The right columns besides `on` must have names of their own.

    An interval lies in bins at least as wide as itself, of widths 4^level, so it meets two bins at most, and a short one
    meets few others there without overlapping them. Two intervals are compared at the level of the longer one: each side
    goes once to its own level and is met there by the shorter rows of the other side, which are repeated per level that
    occurs (33 at most). Of the bins that a pair shares, the one with the later start yields it. Hot bins are spread.
    """
    extra = [c for c in right.columns if c not in on]
    clash = set(extra) & set(left.columns)
    if clash:
        raise ValueError(f"right columns need names of their own: {sorted(clash)}")
    a, b = _levelled(left, *left_bounds, on), _levelled(right, *right_bounds, on)
    levels_a, levels_b = (sorted(r[0] for r in df.select("_level").distinct().collect()) for df in (a, b))
    by = [*[f"_k{i}" for i in range(len(on))], "_bin_level", "_bin"]
    shifted = F.call_function("shiftright", F.greatest("l._low", "r._low"), 2 * F.col("l._bin_level"))
    meet = (
        (F.col("l._from") <= F.col("r._to")) & (F.col("r._from") <= F.col("l._to")) & (F.col("l._bin") == shifted)
    )
    at_left = F.filter(F.lit(levels_a).cast("array<int>"), lambda v: v >= F.col("_level"))
    above = F.filter(F.lit(levels_b).cast("array<int>"), lambda v: v > F.col("_level"))
    longer_left = grid_join(_binned(a, None), _binned(b, at_left), by, meet, ranges)
    longer_right = grid_join(_binned(a, above), _binned(b, None), by, meet, ranges)
    return longer_left.select("l._row", F.col("r._row").alias("_other")).unionAll(
        longer_right.select("l._row", F.col("r._row").alias("_other"))
    ).select("_row.*", *[F.col(f"_other.`{c}`").alias(c) for c in extra])
