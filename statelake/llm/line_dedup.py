"""Line dedup with levelled runs of line hashes, in DataFrame operations only.

Documents are taken in batches of ascending ids. A *run* is a bucketed and sorted table of line hashes seen so far, each
hash once. A batch looks its own hashes up in all runs by merge joins that do not move the runs, and the hashes found in
none become the next run. Whenever `fanout` runs of one level have come together they are merged into one of the next
level, so a hash is rewritten once per level and a batch meets few runs.

Only hashes, ids and positions take part; the text moves once, when the positions to drop meet their document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from statelake.llm.common import BLANKS, LAST_ID, ascii_lower, fresh, named, stored, two_hashes, whole_text

KEY = ("h1", "h2")


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


class Runs:
    """Levelled runs of hashes, as tables bucketed by hash in the warehouse."""

    def __init__(self, spark, buckets: int, fanout: int):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.levels: list[list[str]] = []
        self.made: list[str] = []

    def table(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (df.repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY).format("parquet")
         .saveAsTable(name))
        self.made.append(name)
        return name

    def mark(self, hashes: DataFrame) -> DataFrame:
        """`hashes` with `seen`: whether a run holds it. One merge join per run; a hash is in one run at most."""
        seen = F.lit(False)
        for k, name in enumerate(n for level in self.levels for n in level):
            run = self.spark.table(name).select(*KEY, F.lit(True).alias(f"in{k}"))
            hashes = hashes.join(run.hint("merge"), list(KEY), "left")
            seen = seen | F.coalesce(F.col(f"in{k}"), F.lit(False))
        return hashes.select(*KEY, "first", "last", seen.alias("seen"))

    def add(self, hashes: DataFrame, level: int = 0) -> None:
        self.add_table(self.table(hashes.select(*KEY)), level)

    def add_table(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fanout:
            merged, self.levels[level] = self.levels[level], []
            union = self.spark.table(merged[0])
            for other in merged[1:]:
                union = union.unionAll(self.spark.table(other))
            self.add(union, level + 1)
            for old in merged:
                self.drop(old)

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.made.remove(name)

    def close(self) -> None:
        for name in list(self.made):
            self.drop(name)


def repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4,
    fanout: int = 2,
) -> DataFrame:
    """Positions to drop: `doc`, `text_hash`, `gone` (ascending positions), one row per document that loses lines.

    A line goes if its key has `min_chars` code points or more and a smaller id holds the key as well. A null id reads as
    the largest long; rows that share an id are one document, and each keeps or loses its own lines.
    """
    spark = docs.sparkSession
    text = whole_text(text_col)
    keys = F.transform(F.split(text, "\n"), lambda line, at: F.struct(at.alias("pos"), line_key(line).alias("k")))
    long_keys = F.filter(keys, lambda x: F.length(x["k"]) >= min_chars)
    hashed = F.transform(
        long_keys,
        lambda x: F.struct(x["pos"].alias("pos"), *[h.alias(n) for h, n in zip(two_hashes(x["k"]), KEY)]),
    )
    lines = docs.select(
        F.coalesce(named(id_col), F.lit(LAST_ID)).cast("long").alias("doc"), F.xxhash64(text).alias("text_hash"),
        F.explode(hashed).alias("x"),
    ).select("doc", "text_hash", "x.*")
    lines = stored(lines, "lines")

    steps = [k / batches for k in range(1, batches)]
    edges = lines.agg(F.percentile_approx("doc", steps, 10_000).alias("e")).first()["e"] if steps else []
    edges = sorted(set(edges or []))
    runs = Runs(spark, int(spark.conf.get("spark.sql.shuffle.partitions")), fanout)
    drops = []
    try:
        for low, high in zip([None, *edges], [*edges, None]):
            part = lines
            if low is not None:
                part = part.filter(F.col("doc") > low)
            if high is not None:
                part = part.filter(F.col("doc") <= high)
            per_key = part.groupBy(*KEY).agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
            marked = stored(runs.mark(per_key), "line-batch")
            if high is not None:
                runs.add(marked.filter("not seen"))
            # of most keys there is one document only; those with more meet their lines in a join that AQE can split
            again = marked.filter("seen or last > first")
            drops.append(part.join(again, list(KEY)).filter("seen or doc > first").select("doc", "text_hash", "pos"))
        gone = drops[0]
        for more in drops[1:]:
            gone = gone.unionAll(more)
        # rows repeated as a whole bring a position several times
        return stored(
            gone.groupBy("doc", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("gone")), "line-drops"
        )
    finally:
        runs.close()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: tuple[str, ...] = (
        "n_lines", "n_dropped", "kept_text"), **options) -> DataFrame:
    """`docs` with three columns: lines before, lines dropped, and the text of the lines that stay.

    Lines are what stands between newlines; a null or empty text is one empty line. Every row comes back once, also with
    null or repeated ids; a text that loses all lines becomes empty. `out` names the new columns
    (in lower case); they take the place of columns that `docs` has by these names.
    """
    gone = repeated_lines(docs, id_col, text_col, **options)
    doc, text_hash, drop, lines, merged = fresh(docs, "doc", "text_hash", "gone", "lines", "merged")
    gone = gone.toDF(doc, text_hash, drop)
    text = whole_text(text_col)
    joined = docs.withColumn(doc, F.coalesce(named(id_col), F.lit(LAST_ID)).cast("long")).withColumn(
        text_hash, F.xxhash64(text)
    ).join(gone, [doc, text_hash], "left")
    # positions to drop sort in front of the line they hit; what follows such a mark at the same place goes
    mark = F.transform(
        drop, lambda p: F.struct(p.alias("p"), F.lit(0).alias("f"), F.lit(None).cast("string").alias("line"))
    )
    line = F.transform(
        F.split(text, "\n"), lambda x, at: F.struct(at.alias("p"), F.lit(1).alias("f"), x.alias("line"))
    )
    joined = joined.withColumn(merged, F.when(F.col(drop).isNotNull(), F.array_sort(F.concat(mark, line))))

    def stays(x: Column, at: Column) -> Column:
        before = F.get(F.col(merged), at - 1)
        return (x["f"] == 1) & ~((at > 0) & (before["f"] == 0) & (before["p"] == x["p"]))

    kept = F.transform(F.filter(merged, stays), lambda x: x["line"])
    return joined.select(
        *[named(c) for c in docs.columns if c.lower() not in out],
        F.size(F.split(text, "\n")).cast("long").alias(out[0]),
        F.when(F.col(drop).isNull(), F.lit(0)).otherwise(F.size(drop)).cast("long").alias(out[1]),
        F.when(F.col(drop).isNull(), text).otherwise(F.array_join(kept, "\n")).alias(out[2]),
    )
