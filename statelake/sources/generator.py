"""Seeded synthetic state with hot keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

HOT_FRACTION = 0.05
HOT_WEIGHT = 20.0


def hot_share(keyspace: int, hot_fraction: float = HOT_FRACTION, hot_weight: float = HOT_WEIGHT) -> tuple[int, float]:
    """How many keys are hot, and which share of the rows they get."""
    hot = max(1, int(keyspace * min(1.0, max(0.0, hot_fraction))))
    cold = max(1, keyspace - hot)
    return hot, hot_weight * hot / (hot_weight * hot + cold)


def keyspace_for(rows: int, update_ratio: float) -> int:
    """Number of keys that makes `update_ratio` of the rows updates."""
    return max(1, int(rows * (1.0 - update_ratio)))


def generate_state(
    spark: SparkSession,
    rows: int,
    parts: int = 1,
    keyspace: int | None = None,
    hot_fraction: float = HOT_FRACTION,
    hot_weight: float = HOT_WEIGHT,
    seed: int = 0,
    timestamp: int = 1_700_000_000,
) -> DataFrame:
    """`parts` blobs of `rows` records each; without a keyspace every record has a key of its own."""
    return state_of_ids(spark.range(rows * parts), rows, keyspace, hot_fraction, hot_weight, seed, timestamp)


def _by_hash(text: Column) -> Column:
    return F.xxhash64(text)


def by_md5(text: Column) -> Column:
    """A draw that other engines can repeat: the first 15 hex digits of the digest."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def state_of_ids(
    ids: DataFrame, rows: int, keyspace: int | None = None, hot_fraction: float = HOT_FRACTION, hot_weight: float = HOT_WEIGHT,
    seed: int = 0, timestamp: int = 1_700_000_000, number: Callable[[Column], Column] = _by_hash,
) -> DataFrame:
    """One record per `id` (whole numbers from 0), `rows` of them in a blob.

    Draws are hashes of (seed, id) rather than a random stream, so a retried task makes the same rows.
    """
    def draw(name: str, modulus: int) -> Column:
        return F.pmod(number(F.concat(F.lit(f"{name}{seed}-"), F.col("id").cast("string"))), F.lit(modulus))

    if keyspace:
        hot, share = hot_share(keyspace, hot_fraction, hot_weight)
        is_hot = draw("side", 1_000_000) < F.lit(int(share * 1_000_000))
        key = F.when(is_hot, draw("hot", hot)).otherwise(F.lit(hot) + draw("cold", max(1, keyspace - hot)))
    else:
        key = F.col("id")
    numbered = ids.select("id", key.cast("string").alias("k"))
    unique = F.concat_ws("-", F.lit(str(seed)), F.col("id"))
    return numbered.select(
        F.lit("state_diff").alias("type"),
        F.unhex(F.sha1(F.concat(F.lit("A"), "k").cast("binary"))).alias("address"),
        F.unhex(F.sha2(F.concat(F.lit("K"), "k").cast("binary"), 256)).alias("key"),
        F.unhex(F.sha2(F.concat(F.lit("V"), unique).cast("binary"), 256)).alias("value"),
        F.unhex(F.sha2(F.concat(F.lit("T"), unique).cast("binary"), 256)).alias("tx_hash"),
        (F.call_function("div", "id", F.lit(rows)) + 1).alias("blob_index"),
        (F.col("id") % rows).alias("position"),
        F.lit(timestamp).cast("long").alias("timestamp"),
    )
