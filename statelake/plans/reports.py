"""Wallet reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from statelake import schemas
from statelake.functions import numeric_max_hex

# fixed values: the wallets that are known without an external map
SEED_WALLETS = (
    ("0x36078334509b514626504edc9fb252328d1a240e4e948bef8d0c08dff45927f", "Argent X v0.4.0"),
    ("0x1a736d6ed154502257f02b1ccdf4d9d1089f80811cd6acad48e6b6a9d1f2003", "Argent (Cairo 1)"),
    ("0x25ec026985a3bf9d0cc1fe17326b245dfdc3ff89b8fde106542a3ea56c5a918", "Argent X Proxy (v0.2.x)"),
    ("0x4c6d6cf894f8bc96bb9c525e6853e5483177841f7388f74a46cfda6f028c755", "OpenZeppelin Account"),
)
# fixed value: the system contract left out of the writers report
SYSTEM_ADDRESS = "0x1"


def top(df: DataFrame, value: str, label: str, k: int) -> DataFrame:
    """The k greatest values; the label decides ties."""
    return df.orderBy(F.desc_nulls_last(value), F.asc_nulls_last(label)).limit(k)


def count_by(df: DataFrame, column: str, name: str = "cnt") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(name))


def seed_wallets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SEED_WALLETS), schemas.WALLET_MAP)


def overlay_wallets(seed: DataFrame, external: DataFrame) -> DataFrame:
    """External entries replace seed entries of the same class.

    Of the external ones only class hashes starting 0x with a wallet that is neither blank nor "unknown" count. An
    optional `ord` column says which of two entries for a class is the later one.
    """
    wallet = F.regexp_replace("wallet", r"^\s+|\s+$", "")
    order = F.col("ord").cast("long") if "ord" in external.columns else F.lit(0).cast("long")
    extra = external.filter(F.col("class_hash").startswith("0x")).select(
        F.lower("class_hash").alias("class_hash"), wallet.alias("wallet"), F.lit(1).alias("side"), order.alias("ord")
    ).filter("wallet <> '' and lower(wallet) <> 'unknown'")
    known = seed.select(
        F.lower("class_hash").alias("class_hash"), "wallet", F.lit(0).alias("side"), F.lit(0).cast("long").alias("ord")
    )
    later = F.max_by("wallet", F.struct("side", "ord", "wallet"))
    return known.unionAll(extra).groupBy("class_hash").agg(later.alias("wallet"))


def wallet_share(deployed: DataFrame, wallets: DataFrame, k: int = 12) -> DataFrame:
    """Deployments per known wallet. Counted per class before the join, so a popular class is one row there."""
    classes = count_by(deployed, "class_hash", "n")
    shares = classes.join(wallets, "class_hash").groupBy("wallet").agg(F.sum("n").alias("cnt"))
    return top(shares, "cnt", "wallet", k)


def top_writers(diffs: DataFrame, k: int = 20) -> DataFrame:
    """Addresses with the most writes, without the system contract."""
    counted = diffs.filter(F.col("address").isNotNull() & (F.lower("address") != SYSTEM_ADDRESS))
    return top(count_by(counted, "address", "writes"), "writes", "address", k)


def share_of_shown(shown: DataFrame, value: str) -> DataFrame:
    """Percent of the total of the shown rows; the total is one row, summed in every task first."""
    total = F.broadcast(shown.agg(F.sum(value).alias("_total")))
    share = F.col(value).cast("double") * 100 / F.when(F.col("_total") == 0, 1).otherwise(F.col("_total"))
    return shown.join(total).withColumn("pct", share).drop("_total")


def latest_nonce_text(nonces: DataFrame, k: int = 50) -> DataFrame:
    """Greatest nonce by text, the first k addresses."""
    latest = nonces.groupBy("contract_address").agg(F.max("nonce").alias("latest_nonce"))
    return latest.orderBy(F.asc_nulls_last("contract_address")).limit(k)


def latest_nonce_numeric(nonces: DataFrame) -> DataFrame:
    """Greatest nonce by number, all addresses."""
    return nonces.groupBy("contract_address").agg(numeric_max_hex(F.col("nonce")).alias("latest_nonce"))


def class_ranking(deployed: DataFrame, k: int = 20) -> DataFrame:
    """Classes by number of deployments or replacements."""
    return top(count_by(deployed, "class_hash"), "cnt", "class_hash", k)


def listing(df: DataFrame, columns: list[str], k: int = 50) -> DataFrame:
    """The first k rows of a table in a fixed order."""
    return df.select(*columns).orderBy(*[F.asc_nulls_last(c) for c in columns]).limit(k)
