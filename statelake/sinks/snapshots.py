"""Versioned key-bucketed snapshots (K3, L8) with base and delta parts, sketches of them, and changes between versions.

Base parts lie below bucket=<b>/ of their data folder, a delta is one folder. With `sketches`, every part has a row of
statistics below sketches/<id>/, written with it, and every bucket of a base a Bloom filter of its keys below members/<id>/.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from statelake import schemas
from statelake.operators.lww import KEYS, ORDER, TIES, live_view, lww
from statelake.sinks.tables import write_table
from statelake.sinks.versions import Part, Version, VersionedStore

#: Size of a sketch of keys: 2^12 registers, with a standard error of 1.04 / sqrt(2^12), 1.6 %.
KEY_REGISTERS = 12
#: Bloom filters: bits per key (up to a power of two), bits set by a key, least and greatest logarithm of the bits of a
#: bucket, and bits of one bitmap of Spark. About one in 400 strange keys passes.
BITS_PER_KEY, MARKS, LEAST_LOG, MOST_LOG, MAP_BITS = 12, 4, 15, 30, 1 << 15


class SnapshotStore(VersionedStore):
    """Snapshots of one keyed table.

    `sketches` names long columns whose distribution is kept beside the number of keys; an empty list keeps the keys
    alone, None (the default) nothing.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        schema: T.StructType = schemas.STATE,
        keys: Sequence[str] = KEYS,
        order: Sequence[str] = ORDER,
        ties: Sequence[str] = TIES,
        buckets: int = 64,
        sketches: Sequence[str] | None = None,
    ) -> None:
        super().__init__(spark, root, schema, keys, buckets)
        self.order, self.ties, self.sketches = tuple(order), tuple(ties), None if sketches is None else tuple(sketches)

    def _write_base(self, df: DataFrame) -> list[Part]:
        parts = self._write_buckets("base", df)
        if parts:
            self._sketch(parts[0][2], bucketed=True)
        return parts

    def replace(self, rows: DataFrame, source: str | None = None, batch: int | None = None) -> int:
        """Compact `rows` and publish them as a whole new base."""
        before = self._version()
        base = lww(rows.select(*self.schema.names), self.keys, self.order, self.ties)
        return self._publish(before, self._write_base(base), source, batch)

    def upsert(self, rows: DataFrame, source: str | None = None, batch: int | None = None) -> int:
        """Merge rows into the base and rewrite only the buckets they touch; the older row stays on a tie.

        Deltas take part in the buckets that are rewritten. Their rows can stay in the list: none of them beats a base
        that has met them. With a source and a batch number, a batch not newer than the last of its source has no effect.
        """
        before = self._version()
        if before.has(source, batch):
            return before.number
        buckets = self._touched(rows)
        held = self._live(before, buckets).withColumn("_base", F.lit(1))
        both = held.unionByName(rows.select(*self.schema.names).withColumn("_base", F.lit(0)))
        merged = lww(both, self.keys, self.order, ("_base", *self.ties)).drop("_base")
        kept = [part for part in before.parts if part[0] == "delta" or part[1] not in buckets]
        return self._publish(before, kept + self._write_base(merged), source, batch)

    def append_delta(self, rows: DataFrame, source: str | None = None, batch: int | None = None) -> int:
        """Add rows without touching the base; readers merge them. The cost grows with the batch alone."""
        before = self._version()
        if before.has(source, batch):
            return before.number
        winners = lww(rows.select(*self.schema.names), self.keys, self.order, self.ties)
        data = uuid.uuid4().hex
        write_table(winners, f"{self.root}/data/{data}", mode="errorifexists")
        self._sketch(data, bucketed=False)
        return self._publish(before, [*before.parts, ("delta", None, data)], source, batch)

    def compact(self) -> int:
        """Fold all deltas into the base; buckets that no delta touches are kept as they are."""
        before = self._version()
        deltas = self._deltas(before)
        if deltas is None:
            return self._publish(before, before.parts)
        buckets = self._touched(deltas)
        kept = [part for part in before.parts if part[0] == "base" and part[1] not in buckets]
        return self._publish(before, kept + self._write_base(self._live(before, buckets)))

    def _deltas(self, version: Version) -> DataFrame | None:
        """Rows of all deltas with `_older`, which is greater the earlier a delta was added."""
        rows = None
        for age, folder in enumerate(version.folders("delta")):
            part = self._read([folder]).withColumn("_older", F.lit(-age))
            rows = part if rows is None else rows.unionByName(part)
        return rows

    def _live(self, version: Version, buckets: set[int] | None = None) -> DataFrame:
        """One row per key of a version, or of some of its buckets; of rows that tie the older one stays."""
        base, deltas = self._read(version.folders("base", buckets)), self._deltas(version)
        if deltas is None:
            return base
        if buckets is not None:
            deltas = deltas.filter(self._bucket().isin(sorted(buckets)))
        newest = lww(deltas, self.keys, self.order, ("_older", *self.ties)).drop("_older")
        return live_view(base, newest, self.keys, self.order, self.ties)

    def read(self, version: int | None = None) -> DataFrame:
        """One row per key of a version, by default the newest."""
        return self._live(self._version(version))

    # -- sketches ---------------------------------------------------------------------------------------------------

    def _sketch(self, data: str, bucketed: bool) -> None:
        """One row per bucket of a data folder (a delta: one row): rows, a sketch of keys, sketches of values."""
        if self.sketches is None:
            return
        fields = [self.schema[c] for c in dict.fromkeys((*self.keys, *self.sketches))]
        rows = self._read([data], T.StructType([*fields, *[T.StructField("bucket", T.IntegerType())][:bucketed]]))
        stats = rows.groupBy(F.col("bucket") if bucketed else F.lit(None).cast("int").alias("bucket")).agg(
            F.count(F.lit(1)).alias("rows"),
            F.hll_sketch_agg(F.xxhash64(*self.keys), F.lit(KEY_REGISTERS)).alias("keys"),
            *[F.kll_sketch_agg_bigint(c).alias(f"values_{i}") for i, c in enumerate(self.sketches)],
        )
        stats.withColumn("data", F.lit(data)).coalesce(1).write.parquet(f"{self.root}/sketches/{data}")
        if bucketed:
            counts = self.spark.read.schema("bucket int, rows long").parquet(f"{self.root}/sketches/{data}")
            log = F.ceil(F.log2(F.col("rows") * BITS_PER_KEY)).cast("int")
            sized = F.broadcast(counts.select("bucket", F.greatest(F.lit(LEAST_LOG), F.least(F.lit(MOST_LOG), log)).alias("log")))
            marks = self._marked(rows.select("bucket", *self.keys).join(sized, "bucket"))
            marks.groupBy("bucket", "log", "map").agg(F.bitmap_construct_agg("bit").alias("bits")).write.parquet(
                f"{self.root}/members/{data}"
            )

    def _marked(self, rows: DataFrame) -> DataFrame:
        """A row per bit of each key: `map` and `bit`, in a filter of 2^log bits."""
        first, second = F.xxhash64(*self.keys), F.xxhash64(F.lit(1), *self.keys)
        # both hashes are cut before they are multiplied, so nothing overflows
        short, step = (F.pmod(h, F.lit(1 << 40)) for h in (first, second))
        size = F.pow(F.lit(2.0), "log").cast("long")
        place = F.explode(F.array(*[F.pmod(short + k * step, size) for k in range(MARKS)]))
        at = rows.withColumn("_at", place)
        return at.withColumns({"map": F.floor(F.col("_at") / MAP_BITS).cast("int"), "bit": F.col("_at") % MAP_BITS}).drop("_at")

    def _sketched(self, version: int | None) -> DataFrame:
        """The statistics of all parts of a version; rows and buckets of the data are not read."""
        if self.sketches is None:
            raise ValueError("this store keeps no sketches")
        parts = self._version(version).parts
        schema = "bucket int, rows long, keys binary, data string" + "".join(
            f", values_{i} binary" for i in range(len(self.sketches))
        )
        folders = sorted({data for *_, data in parts})
        if not folders:
            return self.spark.createDataFrame([], f"{schema}, kind string")
        listed = F.broadcast(self.spark.createDataFrame(list(parts), "kind string, at int, of string"))  # bounded by buckets and deltas
        held = self.spark.read.schema(schema).parquet(*[f"{self.root}/sketches/{data}" for data in folders])
        same = F.col("bucket").eqNullSafe(F.col("at")) & (F.col("data") == F.col("of"))
        return held.join(listed, same).drop("at", "of")

    def key_estimate(self, version: int | None = None) -> DataFrame:
        """L10 from sketches: `keys` of a version, and whether that is `exact`.

        A base has one row per key, so without deltas the rows of its buckets are added. With deltas, which repeat keys, the
        sketches of all parts are merged; the estimate is off by more than 5 % about once in 500 times.
        """
        merged = self._sketched(version).agg(
            F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.bool_and(F.col("kind") == "base"), F.lit(True)).alias("exact"),
            F.hll_sketch_estimate(F.hll_union_agg("keys", F.lit(False))).alias("estimate"),
        )
        return merged.select(F.when(F.col("exact"), F.col("rows")).otherwise(F.col("estimate")).alias("keys"), "exact")

    def quantiles(self, column: str, ranks: Sequence[float], version: int | None = None) -> DataFrame:
        """(`rank`, `value`) of a sketched column over the rows of all parts; ranks are met within about 2 %."""
        at = self.sketches.index(column) if self.sketches and column in self.sketches else None
        if at is None:
            raise ValueError(f"{column} is not sketched")
        merged = self._sketched(version).agg(F.kll_merge_agg_bigint(f"values_{at}").alias("all")).filter("all is not null")
        each = [
            F.struct(F.lit(float(r)).alias("rank"), F.kll_sketch_get_quantile_bigint("all", F.lit(float(r))).alias("value"))
            for r in ranks
        ]
        return merged.select(F.inline(F.array(*each)))

    # -- members ----------------------------------------------------------------------------------------------------

    def maybe_held(self, rows: DataFrame, version: int | None = None) -> DataFrame:
        """The distinct keys of `rows` that the base of a version may hold, with `bucket`; the base itself is not read.

        Every key it holds is among them, and about one in 400 of the others.
        """
        if self.sketches is None:
            raise ValueError("this store keeps no sketches")
        parts = [(bucket, data) for kind, bucket, data in self._version(version).parts if kind == "base"]
        keys = rows.select(*self.keys).distinct().withColumn("bucket", self._bucket())
        if not parts:
            return keys.limit(0)
        listed = F.broadcast(self.spark.createDataFrame(parts, "bucket int, data string"))  # bounded by buckets
        folders = [f"{self.root}/members/{data}" for data in sorted({d for _, d in parts})]
        place = F.regexp_extract(F.col("_metadata.file_path"), "/members/([0-9a-f]+)/", 1).alias("data")
        held = self.spark.read.schema("bucket int, log int, map int, bits binary").parquet(*folders).select("*", place)
        held = held.join(listed, ["bucket", "data"]).drop("data")
        logs = F.broadcast(held.select("bucket", "log").distinct())
        byte = F.conv(F.hex(F.expr("substring(bits, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
        is_set = F.call_function("getbit", byte, (F.col("bit") % 8).cast("int")) == 1
        met = self._marked(keys.join(logs, "bucket")).join(held.drop("log"), ["bucket", "map"]).filter(is_set)
        return met.groupBy(*self.keys, "bucket").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == MARKS).drop("_n")

    def live_count(self, recent: DataFrame, version: int | None = None) -> DataFrame:
        """`keys`: how many keys a version and further rows have together.

        The rows of the base are known from its sketches. Of the keys of deltas and `recent`, those that no filter knows are
        new; only the buckets of the others are read.
        """
        held = self._version(version)
        rows, deltas = recent.select(*self.keys), self._read(held.folders("delta")).select(*self.keys)
        keys = rows.unionByName(deltas).distinct()
        maybe = self.maybe_held(keys, version)
        buckets = {r["bucket"] for r in maybe.select("bucket").distinct().collect()}  # at most one number per bucket
        base = self._read(held.folders("base", buckets)).select(*self.keys)
        same = F.lit(True)
        for key in self.keys:
            same = same & F.col(f"r.{key}").eqNullSafe(F.col(f"b.{key}"))
        new = keys.alias("r").join(base.alias("b"), same, "left_anti").agg(F.count(F.lit(1)).alias("new"))
        known = self._sketched(version).filter("kind = 'base'").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
        return new.crossJoin(known).select((F.col("new") + F.col("rows")).alias("keys"))  # one row each

    # -- changes ----------------------------------------------------------------------------------------------------

    def _differing(self, old: Version, new: Version) -> set[int]:
        """Buckets in which two versions may differ: another base folder, or keys of a delta that only one of them has."""
        bases = [{(b, d) for kind, b, d in v.parts if kind == "base"} for v in (old, new)]
        deltas = [{d for kind, _, d in v.parts if kind == "delta"} for v in (old, new)]
        found = {bucket for bucket, _ in bases[0] ^ bases[1]}
        only = sorted(deltas[0] ^ deltas[1])
        return found | self._touched(self._read(only)) if only else found

    def changes(self, old: int, new: int) -> DataFrame:
        """What turns version `old` into version `new`: `change` (insert, update, delete), `before`, `after` (whole rows).

        Only buckets that differ are read and joined; rows that were rewritten as they were are no change.
        """
        versions = self._version(old), self._version(new)
        buckets = self._differing(*versions)
        names = [f"`{c}`" for c in self.schema.names]
        sides = [self._live(v, buckets).select(F.struct(*names).alias("row")) for v in versions]
        a, b = sides[0].alias("a"), sides[1].alias("b")
        same = F.lit(True)
        for key in self.keys:
            same = same & F.col(f"a.row.{key}").eqNullSafe(F.col(f"b.row.{key}"))
        kind = F.when(F.col("a.row").isNull(), "insert").when(F.col("b.row").isNull(), "delete").otherwise("update")
        both = a.join(b, same, "full").filter(~F.col("a.row").eqNullSafe(F.col("b.row")))
        return both.select(kind.alias("change"), F.col("a.row").alias("before"), F.col("b.row").alias("after"))
