"""Tables laid out along a space-filling curve, so that a bound on any of several columns skips files and row groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from statelake.operators.hot import ranges_of
from statelake.sinks.tables import write_table

#: Bits of a column on the curve, and sampled values per step of a column.
BITS, PER_STEP = 6, 100


def quantile_steps(df: DataFrame, columns: Sequence[str], bits: int = BITS) -> dict[str, list]:
    """Per column at most 2^bits - 1 values that cut a bounded sample of it into equal parts; nulls are left out.

    Repeated values make fewer steps, so a value that fills half of a column does not use up its steps.
    """
    wanted = PER_STEP << bits
    rows = df.count()
    drawn = df.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(columns)])
    if rows > wanted:
        drawn = drawn.sample(wanted / rows, seed=5)
    held = drawn.collect()  # PER_STEP * 2^bits rows of the columns alone, more or less
    out = {}
    for i, name in enumerate(columns):
        values = sorted(bytes(r[i]) if isinstance(r[i], bytearray) else r[i] for r in held if r[i] is not None)
        cuts = [values[len(values) * k >> bits] for k in range(1, 1 << bits)] if values else []
        out[name] = sorted(set(cuts))
    return out


def curve_key(steps: dict[str, list], bits: int = BITS) -> Column:
    """Place on a Morton curve: the bits of the steps of all columns, interleaved from the highest."""
    key = F.lit(0).cast("long")
    for j, (name, cuts) in enumerate(steps.items()):
        value = F.col(f"`{name}`")
        passed = F.lit(0) if not cuts else F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= value)), F.lit(0))
        for b in range(bits):
            bit = F.call_function("getbit", passed.cast("long"), F.lit(b)).cast("long")
            key = key + bit * F.lit(1 << (b * len(steps) + j))
    return key


def write_along_curve(
    df: DataFrame, path: str, columns: Sequence[str], bits: int = BITS, row_group_bytes: int | None = None, ranges: int | None = None,
) -> None:
    """Write `df` as Parquet in the order of the curve over `columns`: one shuffle by ranges of the curve, sorted inside files.

    Steps come from quantiles, so the curve follows the data. A range of the curve is one cell at least; rows of one cell
    that fill more than a range are spread by a hash of the row.
    """
    steps = quantile_steps(df, columns, bits)
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    keyed = df.withColumns({"_curve": curve_key(steps, bits), "_spread": spread})
    ranged = keyed.repartitionByRange(ranges or ranges_of(df), "_curve", "_spread").sortWithinPartitions("_curve", "_spread")
    write_table(ranged.drop("_curve", "_spread"), path, row_group_bytes=row_group_bytes)
