"""Complete blob sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# indexes of a group that meet their verdict in one task
SLICE = 4096


def complete_sets(items: DataFrame) -> DataFrame:
    """(eth_block, tx_hash, idx, path) of the groups whose indexes are exactly 0..max, without gap or double.

    A group is judged by counts alone and never gathered. Duplicates collapse before the shuffle, and a large group
    meets its verdict in slices of the index, so its rows are shared by many tasks.
    """
    group = ["eth_block", "tx_hash"]
    each = items.groupBy(*group, "idx").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path"))
    judged = each.groupBy(*group).agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("indexes"),
        F.min("idx").alias("low"), F.max("idx").alias("high"),
    )
    complete = judged.filter("rows = indexes and low = 0 and high = indexes - 1").select(
        *group, F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", "high", F.lit(SLICE)))).alias("slice")
    )
    sliced = each.withColumn("slice", F.call_function("div", "idx", F.lit(SLICE)))
    # a set has one row per slice, so this is a semi join; written as one, Spark would move it below the counting
    return sliced.join(complete, [*group, "slice"]).select(*group, "idx", "path")


def manifest_entries(complete: DataFrame) -> DataFrame:
    """Complete sets as manifest rows in long form, for sets of any size: (eth_block, tx_hash, position, path).

    The indexes of a complete set are 0 up without gap, so the index is the position in the set.
    """
    return complete.select("eth_block", "tx_hash", F.col("idx").alias("position"), "path")
