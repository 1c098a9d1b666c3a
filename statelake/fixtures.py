"""State-shaped views over general tables (orders, events, customers ...), used by queries, tests and bench."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def dealt_out(df: DataFrame, rows: int) -> DataFrame:
    """`df` in partitions of about `rows` rows, for small rows that become much larger ones."""
    return df.repartition(max(1, -(-df.count() // rows)))


def state_events(spark: SparkSession, root: str) -> DataFrame:
    """One write per event: key per user, blob per day, four blobs share a timestamp."""
    events = table(spark, root, "events").selectExpr(
        "*", "cast(datediff(cast(ts as date), date'2024-01-01') + 1 as bigint) as b"
    )
    return events.selectExpr(
        "case when event_type = 'purchase' then 'tx' else 'state_diff' end as type",
        "concat('0x', sha1(concat('A', user_id))) as address",
        "concat('0x', sha2(concat('K', user_id), 256)) as key",
        "concat('0x', sha2(concat('V', event_id), 256)) as value",
        "concat('0x', sha2(concat('T', event_id), 256)) as tx_hash",
        "b as blob_index",
        "event_id as position",
        "1704067200 + 345600 * ((b - 1) div 4) as timestamp",
    )


def state_orders(spark: SparkSession, root: str) -> DataFrame:
    """One write per order: key per customer, blob per month."""
    orders = table(spark, root, "orders").selectExpr(
        "*", "cast((year(o_orderdate) - 1995) * 12 + month(o_orderdate) as bigint) as b"
    )
    return orders.selectExpr(
        "'state_diff' as type",
        "concat('0x', sha1(concat('A', o_custkey))) as address",
        "concat('0x', sha2(concat('K', o_custkey), 256)) as key",
        "concat('0x', sha2(concat('V', o_orderkey), 256)) as value",
        "concat('0x', sha2(concat('T', o_orderkey), 256)) as tx_hash",
        "b as blob_index",
        "o_orderkey as position",
        "788918400 + (b - 1) * 86400 as timestamp",
    )


def binary_state(state: DataFrame) -> DataFrame:
    """The text hashes of a state view as binary columns."""
    return state.selectExpr(
        "type",
        *[f"unhex(substring({c}, 3)) as {c}" for c in ("address", "key", "value", "tx_hash")],
        "blob_index", "position", "cast(timestamp as bigint) as timestamp",
    )


def storage_diffs(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "lineitem").selectExpr(
        "concat('0x', lower(hex(l_suppkey))) as address",
        "concat('0x', lower(hex(l_partkey))) as key",
        "concat('0x', lower(hex(cast(l_quantity as bigint)))) as value",
        "'lineitem' as src",
    )


def deployed(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "customer").selectExpr(
        "concat('0x', lower(hex(c_custkey))) as address",
        "concat('0x', sha2(c_mktsegment, 256)) as class_hash",
        "'customer' as src",
    )


def wallet_map(spark: SparkSession) -> DataFrame:
    """Four of the five market segments; the fifth stays unknown on purpose."""
    return spark.sql(
        "select concat('0x', sha2(s, 256)) as class_hash, w as wallet from values "
        "('BUILDING', 'Wallet A'), ('AUTOMOBILE', 'Wallet B'), ('FURNITURE', 'Wallet C'), "
        "('HOUSEHOLD', 'Wallet C') as t(s, w)"
    )


def nonces(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "conversations").selectExpr(
        "concat('0x', lower(hex(conv_id))) as contract_address",
        "concat('0x', lower(hex(turn * 5))) as nonce",
        "'conversations' as src",
    )


def blob_items(spark: SparkSession, root: str) -> DataFrame:
    """One blob per conversation turn, with some turns missing."""
    return table(spark, root, "conversations").filter("(conv_id * 7 + turn) % 11 <> 0").selectExpr(
        "conv_id as eth_block",
        "concat('0x', sha2(concat('T', conv_id), 256)) as tx_hash",
        "turn as idx",
        "concat('blob-', conv_id, '-', turn) as path",
    )
