"""Nested state diffs to flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from statelake import schemas
from statelake.functions import canonical_int, is_surrogate, norm_hex
from statelake.operators.sizing import fits, lookup_join


def _rows(documents: DataFrame, field: str) -> DataFrame:
    return documents.select("src", F.explode(f"doc.{field}").alias("e")).filter("e is not null")


def _flat(documents: DataFrame, table: str) -> DataFrame:
    names = [name for name in schemas.DIFF_TABLES[table].names if name != "src"]
    return _rows(documents, table).select(*[norm_hex(F.col(f"e.{n}")).alias(n) for n in names], "src")


def storage_diffs(documents: DataFrame) -> DataFrame:
    """One row per storage entry; null or missing lists give no rows."""
    diffs = _rows(documents, "storage_diffs").select(
        norm_hex(F.col("e.address")).alias("address"), F.explode("e.storage_entries").alias("s"), "src"
    ).filter("s is not null")
    return diffs.select(
        "address", norm_hex(F.col("s.key")).alias("key"), norm_hex(F.col("s.value")).alias("value"), "src"
    )


def declared_classes(documents: DataFrame) -> DataFrame:
    """D2."""
    return _flat(documents, "declared_classes")


def deployed_or_replaced(documents: DataFrame) -> DataFrame:
    """D3."""
    return _flat(documents, "deployed_or_replaced")


def nonces(documents: DataFrame) -> DataFrame:
    """D4."""
    return _flat(documents, "nonces")


FLATTENERS = {
    "storage_diffs": storage_diffs,
    "declared_classes": declared_classes,
    "deployed_or_replaced": deployed_or_replaced,
    "nonces": nonces,
}


def flatten_contracts(documents: DataFrame) -> DataFrame:
    """(addr, key, value, class_hash, nonce) as decimal text; a pair is {key, value} or [key, value]."""
    contracts = documents.select(F.explode("doc.contracts").alias("c")).filter("c is not null and size(c.storage) > 0")
    # what a contract says once is made canonical before its pairs are taken apart
    pairs = contracts.select(
        canonical_int(F.coalesce("c.address", F.lit("0"))).alias("addr"), canonical_int(F.col("c.class_hash")).alias("class_hash"),
        canonical_int(F.col("c.nonce")).alias("nonce"), F.explode("c.storage").alias("json"),
    )

    def as_list(pair: Column) -> Column:
        # each form is parsed once and then taken apart
        named = F.transform(F.array(F.from_json(pair, schemas.STORAGE_PAIR)), lambda p: F.array(p["key"], p["value"]))
        listed = F.from_json(pair, T.ArrayType(T.StringType()))
        bad = F.raise_error(F.concat(F.lit("not a storage pair: "), F.coalesce(pair, F.lit("null"))))
        two = F.when(F.size(listed) == 2, listed).otherwise(bad)
        return F.when(pair.startswith("["), two).when(pair.startswith("{"), named[0]).otherwise(bad)

    split = pairs.select("addr", "class_hash", "nonce", F.explode(F.array(as_list(F.col("json")))).alias("pair"))
    return split.select(
        "addr", canonical_int(F.get("pair", F.lit(0))).alias("key"), canonical_int(F.get("pair", F.lit(1))).alias("value"),
        "class_hash", "nonce",
    )


def resolve_indexes(
    rows: DataFrame, index_map: DataFrame, columns: tuple[str, ...] = ("addr", "key"), salts: int = 16
) -> DataFrame:
    """Replace surrogates (2^127 and up) found in `index_map` (idx, val); literals and misses stay."""
    known = index_map.select(canonical_int(F.col("idx")).alias("_idx"), canonical_int(F.col("val")).alias("_val"))
    known = known.filter(is_surrogate(F.col("_idx"))).groupBy("_idx").agg(F.min("_val").alias("_val"))
    names, small = rows.columns, fits(known)
    for column in columns:
        keyed = rows.withColumn("_idx", F.col(column))
        found = lookup_join(keyed, known, "_idx", salts, small)
        rows = found.select(*[F.coalesce("_val", column).alias(column) if n == column else F.col(n) for n in names])
    return rows
