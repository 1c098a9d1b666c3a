"""Blob listings: saved API pages to one normal row per blob, and pages of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from statelake import schemas
from statelake.functions import iso_seconds


def _filled(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def _first_url(refs: str) -> Column:
    urls = F.filter(F.col(refs)["url"], lambda u: u.isNotNull() & (u != ""))
    return F.get(urls, F.lit(0))


def normalise_items(items: DataFrame) -> DataFrame:
    """Rows in the item schema -> (eth_block, tx_hash, idx, timestamp, timestamp_missing, url).

    Field names have alternatives; zero and empty text count as absent. Items without a storage URL are dropped.
    An item without a readable time keeps a null and a flag, so that repeated runs agree.
    """
    has_refs = F.size("dataStorageReferences") > 0
    url = F.coalesce(
        F.when(has_refs, _first_url("dataStorageReferences")).otherwise(_first_url("data_storage_references")),
        F.nullif(F.col("storage.url"), F.lit("")),
        _filled("storageUrl"),
    )
    seconds = F.coalesce(
        F.col("timestamp").cast("long"), iso_seconds(F.coalesce(_filled("blockTimestamp"), _filled("time")))
    )
    zero = F.lit(0).cast("long")
    return items.select(
        F.coalesce(F.nullif(F.col("eth_block_number"), zero), F.col("blockNumber"), zero).alias("eth_block"),
        F.coalesce(_filled("tx_hash"), F.col("txHash"), F.lit("")).alias("tx_hash"),
        F.coalesce(F.col("index"), zero).alias("idx"),
        seconds.alias("timestamp"),
        seconds.isNull().alias("timestamp_missing"),
        url.alias("url"),
    ).filter("url is not null")


def items_in(pages: DataFrame, text: str = "value") -> DataFrame:
    """Page texts (object with `items`, object with `blobs`, or a bare list) -> rows in the item schema."""
    listed = T.ArrayType(schemas.BLOB_ITEM)
    page = T.StructType([T.StructField("items", listed), T.StructField("blobs", listed)])
    body = F.btrim(F.col(text), F.lit(" \t\r\n"))
    parsed = F.from_json(body, page)
    items = F.when(body.startswith("["), F.from_json(body, listed)).otherwise(
        F.coalesce(parsed["items"], parsed["blobs"])
    )
    return pages.select(F.explode(items).alias("item")).filter("item is not null").select("item.*")


def read_items(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Normalised blob items of saved pages, one page per file."""
    return normalise_items(items_in(spark.read.text(path, wholetext=True)))


def page_of(
    items: DataFrame,
    page: int = 1,
    page_size: int = 50,
    start_block: int = 0,
    end_block: int = 0,
    max_items: int | None = None,
) -> DataFrame:
    """One page, newest block first; a bound of 0 is no bound, both bounds are inclusive."""
    if start_block:
        items = items.filter(F.col("eth_block") >= start_block)
    if end_block:
        items = items.filter(F.col("eth_block") <= end_block)
    ordered = items.orderBy(F.desc("eth_block"), F.desc("idx"), F.desc("tx_hash"), F.desc("url"))
    size = page_size if max_items is None else min(page_size, max_items)
    return ordered.offset((page - 1) * page_size).limit(size)
