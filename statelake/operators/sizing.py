"""Broadcast only what was measured to be small; spread what may hang on one key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

MAX_ROWS = 1_000_000
MAX_BYTES = 64 << 20


def measure(df: DataFrame) -> tuple[int, int, int]:
    """Rows, bytes (text and binary cells plus eight per cell), estimated distinct rows; three numbers, one pass."""
    width = F.lit(8 * len(df.columns))
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0))
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    seen = df.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(width).alias("bytes"), F.approx_count_distinct(row).alias("distinct")
    ).first()
    return seen["rows"], seen["bytes"] or 0, seen["distinct"]


def within(rows: int, volume: int) -> bool:
    return rows <= MAX_ROWS and volume <= MAX_BYTES


def fits(df: DataFrame) -> bool:
    """Whether `df`, measured now, is small enough to be broadcast."""
    return within(*measure(df)[:2])


def lookup_join(df: DataFrame, lookup: DataFrame, on: str, salts: int = 16, small: bool | None = None) -> DataFrame:
    """LEFT join against a lookup with one row per `on`, safe when one value of `on` holds much of `df`.

    A lookup that is measured to be small is broadcast, and `df` is not shuffled. A larger one is repeated once per
    salt, and the rows of a value are spread by a hash of the whole row, so a retried task sends them the same way.
    """
    if fits(lookup) if small is None else small:
        return df.join(F.broadcast(lookup), on, "left")
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(salts))
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return df.withColumn("_salt", spread).join(copies, [on, "_salt"], "left").drop("_salt")
