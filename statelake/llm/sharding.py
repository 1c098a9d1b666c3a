"""Sharding by sampled splitters: shards of near equal bytes, in DataFrame operations only.

Records are ordered by a key (digest of the text, id), so equal texts stand together. Keys are drawn with a chance in
proportion to the size of the record; quantiles of the draw are the splitters of ranges. The bytes of the ranges are
counted over all rows, and a range that came out too full is split again by a denser draw inside it. The ranges are then
windows of bounded size: a running sum in each, plus what lies in front of it, is the place of every record in the order
of all, and that place decides shard and slot. The draw only decides how even the tasks are, never the result.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window, functions as F

from statelake.llm.common import fresh, named, stored, whole_text

FIRST_ID = -(1 << 63)


def _range_of(key: Column, tie: Column, splitters: list[tuple[str, int]]) -> Column:
    """Number of splitters below (key, tie): a binary search over two literal arrays."""
    if not splitters:
        return F.lit(0)
    keys, ties = F.lit([k for k, _ in splitters]), F.lit([int(t) for _, t in splitters])
    steps = F.sequence(F.lit(1), F.lit(len(splitters).bit_length()))

    def step(at: Column, _: Column) -> Column:
        mid = ((at["lo"] + at["hi"]) / 2).cast("int")
        k, t = F.get(keys, mid), F.get(ties, mid)
        below = (k < key) | ((k == key) & (t < tie))
        open_ = at["lo"] < at["hi"]
        return F.struct(
            F.when(open_ & below, mid + 1).otherwise(at["lo"]).alias("lo"),
            F.when(open_ & ~below, mid).otherwise(at["hi"]).alias("hi"),
        )

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(splitters)).alias("hi"))
    return F.aggregate(steps, start, step, lambda at: at["lo"])


def _draw(keyed: DataFrame, key: str, tie: str, size: str, per_byte: float, seed: int) -> DataFrame:
    """Keys kept with chance size * per_byte, by a hash, so that a repeated task draws the same; with their weight."""
    chance = F.col(size) * F.lit(per_byte)
    number = F.pmod(F.xxhash64(F.lit(seed), key, tie), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return keyed.filter(number < chance).select(
        F.col(key).alias("k"), F.col(tie).alias("t"), F.greatest(chance, F.lit(1.0)).alias("w")
    )


def _quantiles(drawn: list[tuple[str, int, float]], parts: int) -> list[tuple[str, int]]:
    drawn = sorted(drawn)
    total, run, out = sum(w for *_, w in drawn), 0.0, []
    for k, t, w in drawn:
        run += w
        if run * parts >= total * (len(out) + 1) and len(out) < parts - 1:
            out += [(k, t)] * max(1, min(int(run * parts / total), parts - 1) - len(out))
    return sorted(set(out))


def sharded(
    records: DataFrame, key_col: str, id_col: str, size_col: str, shards: int = 16, ranges: int | None = None,
    draws_per_range: int = 32, rounds: int = 3,
) -> DataFrame:
    """`records` with `shard` (0 up) and `slot` (place in the shard, from 0 without gaps); sizes must be 1 or more.

    Records are in the order of (key, id); a record belongs to the shard in which its first byte falls when the bytes of
    all are cut into `shards` equal parts, so shards differ by the size of one record at most. Null ids come first; rows
    equal in key and id are interchangeable, stand together and are told apart by their place only. No rows: no rows.
    `ranges` is four times the shuffle partitions unless given. The driver sees splitters (one per range), draws
    (`draws_per_range` for each) and the counts of ranges. All columns of `records` are carried, so pass few.
    """
    spark = records.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie, at, cum, row = fresh(records, "tie", "range", "cum", "row")
    keyed = records.withColumn(tie, F.coalesce(named(id_col), F.lit(FIRST_ID)).cast("long"))
    total = keyed.agg(F.sum(size_col)).first()[0] or 0
    goal = max(1.0, total / ranges)
    splitters: list[tuple[str, int]] = []
    if total:
        drawn = _draw(keyed, key_col, tie, size_col, draws_per_range / goal, 0).collect()
        splitters = _quantiles([tuple(r) for r in drawn], ranges)
    for seed in range(1, rounds + 1):
        place = _range_of(F.col(key_col), F.col(tie), splitters)
        counts = keyed.select(place.alias("r"), F.col(size_col).alias("z")).groupBy("r").agg(
            F.sum("z").alias("bytes"), F.count(F.lit(1)).alias("n")
        ).collect()
        full = {c["r"]: c["bytes"] for c in counts if c["bytes"] > 2 * goal and c["n"] > 1}
        if not full or seed == rounds:
            break
        inside = keyed.filter(place.isin(list(full)))
        more: dict[int, list] = {}
        for k, t, w in _draw(inside, key_col, tie, size_col, 4 * draws_per_range / goal, seed).collect():
            more.setdefault(bisect_left(splitters, (k, t)), []).append((k, t, w))
        found = {x for r, d in more.items() for x in _quantiles(d, 1 + int(full.get(r, goal) / goal))}
        if found <= set(splitters):
            break
        splitters = sorted({*splitters, *found})

    before_bytes, before_rows, by_range = [], [], {c["r"]: c for c in counts} if total else {}
    b = n = 0
    for r in range(len(splitters) + 1):
        before_bytes.append(b)
        before_rows.append(n)
        if r in by_range:
            b, n = b + by_range[r]["bytes"], n + by_range[r]["n"]
    placed = keyed.withColumn(at, _range_of(F.col(key_col), F.col(tie), splitters))
    order = Window.partitionBy(at).orderBy(key_col, tie)
    so_far = F.sum(size_col).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = placed.withColumns({cum: so_far - F.col(size_col), row: F.row_number().over(order).cast("long") - 1})
    done = first.withColumns({
        cum: F.col(cum) + F.get(F.lit(before_bytes), F.col(at)), row: F.col(row) + F.get(F.lit(before_rows), F.col(at)),
    })
    done = stored(
        done.withColumn("shard", F.expr(f"int((`{cum}` * {shards}L) div {max(1, total)}L)")).drop(tie, at, cum), "shards"
    )
    starts = {r["shard"]: r["s"] for r in done.groupBy("shard").agg(F.min(row).alias("s")).collect()}
    start = F.get(F.lit([starts.get(s, 0) for s in range(shards)]), F.col("shard"))
    return done.withColumn("slot", F.col(row) - start).drop(row)


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16) -> DataFrame:
    """`doc_id`, `size`, `text_crc32`, `shard`, `slot` of every row; size is the bytes of the text (null: none) plus 1."""
    text = whole_text(text_col)
    records = docs.select(
        F.md5(text.cast("binary")).alias("text_md5"), named(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return sharded(records, "text_md5", "doc_id", "size", shards)


def write_shards(sharded_rows: DataFrame, path: str) -> None:
    """One folder per shard; inside files rows are in slot order."""
    sharded_rows.repartition("shard", F.expr("slot div 100000")).sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard"
    ).parquet(path)
