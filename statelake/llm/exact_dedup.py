"""Exact dedup by recipes of content-defined chunks, in DataFrame operations only.

A text is cut where its content says so: behind the first sentence or line end after `shortest` code points, at
`longest` at the latest, so equal texts have equal cuts. A chunk is named by 128 bits of hash, and the name is *verified*:
all chunks of one name are compared as texts, once, below a shuffle that sends each different chunk once per task. Where
a name stands for several texts (a hash collision), the chunk itself becomes part of the name. Rows are then compared by
their ordered lists of names, some sixteen bytes for each chunk, and no document moves as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from statelake.llm.common import ascii_lower, named, stored, two_hashes, whole_text

SHORTEST, LONGEST = 256, 4096


def chunks(text: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """The pieces of `text` in order; joined they are the text. An empty text has none."""
    cut = f"(?s).{{{shortest},{longest - 1}}}?[\\n.!?]|.{{1,{longest}}}"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def recipes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    names: Callable[[Column], tuple[Column, Column]] = two_hashes,
) -> DataFrame:
    """`doc_id`, `text_sha256` and `recipe`, the ordered list of verified chunk names (h1, h2, v), one row per row.

    `v` is empty unless different chunks share `h1` and `h2`; then it is the chunk.
    """
    text = ascii_lower(whole_text(text_col))
    base = docs.select(named(id_col).cast("long").alias("doc_id"), text.alias("text"))

    def name(c: Column) -> Column:
        h1, h2 = names(c)
        return F.struct(h1.alias("h1"), h2.alias("h2"), F.lit("").alias("v"))

    plain = base.select(
        "doc_id", F.sha2("text", 256).alias("text_sha256"), F.transform(chunks(F.col("text")), name).alias("recipe")
    )
    plain = stored(plain, "recipes")
    pieces = base.select(F.explode(chunks(F.col("text"))).alias("c"))
    h1, h2 = names(F.col("c"))
    wrong = stored(
        pieces.select(h1.alias("h1"), h2.alias("h2"), "c").groupBy("h1", "h2")
        .agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("h1", "h2"),
        "chunk-collisions",
    )
    if wrong.isEmpty():
        return plain
    # rare, and exact all the same: the chunks of shared names are put in the place of their names
    placed = base.select(
        "doc_id", F.sha2("text", 256).alias("text_sha256"), F.posexplode(chunks(F.col("text"))).alias("pos", "c")
    ).withColumns({"h1": h1, "h2": h2})
    told = placed.join(wrong.withColumn("hit", F.lit(True)), ["h1", "h2"], "left").select(
        "doc_id", "text_sha256",
        F.struct("pos", "h1", "h2", F.when(F.col("hit"), F.col("c")).otherwise(F.lit("")).alias("v")).alias("x"),
    )
    lists = told.groupBy("doc_id", "text_sha256").agg(F.sort_array(F.collect_set("x")).alias("xs")).select(
        F.col("doc_id").alias("d"), F.col("text_sha256").alias("s"),
        F.transform("xs", lambda x: F.struct(x["h1"], x["h2"], x["v"])).alias("better"),
    )
    both = plain.join(lists, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_sha256") == F.col("s")), "left")
    return stored(both.select("doc_id", "text_sha256", F.coalesce("better", "recipe").alias("recipe")), "recipes")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of `docs`: `doc_id`, `keep_id`, `group_size`, `kept`, `text_sha256` (of the lower-cased text).

    Texts are equal when they are after lower-casing A-Z; a null text is empty, and all empty texts are one group. The
    row with the largest id stays; a null id is smaller than every other (a group of null ids keeps them: keep_id is null).
    Rows repeated as a whole are counted each, and all those with the id that stays are marked `kept`.
    """
    rows = recipes(docs, id_col, text_col, **options).withColumn("r", F.xxhash64("recipe"))
    # counted in every task first; only recipes of several rows take part in the join, which AQE splits if one is hot
    groups = rows.groupBy("r", "recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    several = stored(groups.filter("group_size > 1"), "recipe-groups")
    joined = rows.join(several, ["r", "recipe"], "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )
