"""Dataset catalogues: lists of files as tables.

Inside a kind, entries are ordered by `ord` and then by path; a catalogue without `ord` is ordered by path alone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from statelake.functions import absolute_path, file_name
from statelake.operators.sizing import lookup_join
from statelake.sinks.tables import write_json_lines
from statelake.sources.files import list_files, manifest_text, write_text

# fixed values: kinds of a catalogue, and the extensions of the arrow kind
KINDS = ("arrow", "parquet", "files", "urls")
COUNTED_KINDS = ("arrow", "parquet", "files", "segments")
REMAPPED_KINDS = ("arrow", "parquet", "files")
ARROW_EXTENSIONS = ("arrow", "ipc", "feather")


def placed(catalog: DataFrame) -> DataFrame:
    """The catalogue with `ord`, 0 where it has none."""
    return catalog if "ord" in catalog.columns else catalog.withColumn("ord", F.lit(0).cast("long"))


def build_catalog(spark: SparkSession, root: str, include_parquet: bool = False) -> DataFrame:
    """(kind, path, ord) of the data files below a folder, paths relative to it. File contents are not read.

    Sorted paths are the order of a kind, so `ord` is 0.
    """
    name = F.lower(file_name(F.col("path")))
    arrow = name.rlike(r"\.(" + "|".join(ARROW_EXTENSIONS) + ")$")
    kind = F.when(arrow, "arrow")
    if include_parquet:
        kind = kind.when(name.endswith(".parquet"), "parquet")
    below = re.sub("^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", root).rstrip("/")
    relative = F.regexp_replace("path", r"^.*?\Q" + below + r"/\E", "")
    files = list_files(spark, root, recursive=True).select(kind.alias("kind"), relative.alias("path"))
    return placed(files.filter("kind is not null"))


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A JSON manifest as catalogue (kind, path, ord) and segments (file, path, url, ord); `manifest_base` has its base."""
    lists = T.StructType([T.StructField(kind, T.ArrayType(T.StringType())) for kind in KINDS])
    entries = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("file", "path", "url")]))
    schema = T.StructType([*lists.fields, T.StructField("segments", entries)])
    manifest = manifest_text(spark, path).select(F.from_json("value", schema).alias("m"))
    by_kind = F.create_map(*[part for kind in KINDS for part in (F.lit(kind), F.col(f"m.{kind}"))])
    paths = manifest.select(F.explode(by_kind).alias("kind", "paths")).select("kind", F.posexplode("paths").alias("ord", "path"))
    segments = manifest.select(F.posexplode("m.segments").alias("ord", "s")).filter("s is not null")
    return (
        paths.filter("path is not null").select("kind", "path", F.col("ord").cast("long").alias("ord")),
        segments.select("s.*", F.col("ord").cast("long").alias("ord")),
    )


def manifest_base(spark: SparkSession, path: str) -> str | None:
    """The base that a manifest names."""
    return manifest_text(spark, path).select(F.get_json_object("value", "$.base")).first()[0]


def merged_base(local: str | None, remote: str | None) -> str | None:
    """The remote base, or where it has none the local one."""
    return remote or local


def _rows(df: DataFrame, *order: str) -> Iterator:
    return df.orderBy(*order).toLocalIterator()


def _listed(name: str, values: Iterator[str]) -> Iterator[str]:
    yield f"{json.dumps(name)}: ["
    for k, value in enumerate(values):
        yield f"{', ' if k else ''}{json.dumps(value)}"
    yield "]"


def write_manifest(catalog: DataFrame, segments: DataFrame | None, path: str, base: str | None = None) -> None:
    """The JSON manifest that `read_manifest` reads. Entries stream to the one file in order, a Spark partition at a time."""
    def text() -> Iterator[str]:
        yield f'{{"base": {json.dumps(base)}'
        for kind in KINDS:
            rows = placed(catalog).filter((F.col("kind") == kind) & F.col("path").isNotNull())
            yield ", "
            yield from _listed(kind, (row["path"] for row in _rows(rows, "ord", "path")))
        if segments is not None:
            columns = [c for c in segments.columns if c not in ("ord", "side")]
            order = [c for c in ("side", "ord") if c in segments.columns]
            yield ", "
            whole = ({c: row[c] for c in columns if row[c] is not None} for row in _rows(segments, *order))
            yield from _listed("segments", whole)
        yield "}"

    write_text(catalog.sparkSession, path, text())


# one row per entry: of a path (kind, ord, path), of a segment (kind "segments"), or the base (kind "base")
ENTRIES = "kind string, ord long, file string, path string, url string"


def numbered(entries: DataFrame, order: Sequence[str], scratch: str) -> DataFrame:
    """`entries` with a dense `number` from 0 by kind in the given order.

    They are sorted into ranges and stored below `scratch`; a range counts its entries of a kind, and what lies in front of
    it is added to the places inside it. So no kind passes one task.
    """
    spark = entries.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = ["kind", *order]
    entries.repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id()).write.parquet(scratch)
    ranged = spark.read.parquet(scratch)
    counts = ranged.groupBy("kind", "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("kind").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("kind", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("kind", "_part").orderBy(*order)
    # a row per kind and range
    placed_at = ranged.withColumn("_at", F.row_number().over(inside) - 1).join(F.broadcast(before), ["kind", "_part"])
    return placed_at.withColumn("number", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def write_entries(catalog: DataFrame, segments: DataFrame | None, root: str, base: str | None = None) -> None:
    """A manifest of any size as JSON lines, one per entry, below root/entries; tasks write them where they are.

    `write_manifest` makes the one JSON file of the format of it, for catalogues that fit one.
    """
    spark, text = catalog.sparkSession, T.StringType()
    rows = placed(catalog).filter(F.col("kind").isin(*KINDS) & F.col("path").isNotNull()).select(
        "kind", F.lit(0).alias("side"), "ord", F.lit(None).cast(text).alias("file"), "path", F.lit(None).cast(text).alias("url")
    )
    if segments is not None:
        side = F.col("side") if "side" in segments.columns else F.lit(0)
        rows = rows.unionByName(segments.select(
            F.lit("segments").alias("kind"), side.cast("int").alias("side"), "ord",
            *[F.col(c) if c in segments.columns else F.lit(None).cast(text).alias(c) for c in ("file", "path", "url")],
        ))
    dense = numbered(rows, ["side", "ord", "path", "file", "url"], f"{root}/ranges").select(
        "kind", F.col("number").alias("ord"), "file", "path", "url"
    )
    own = spark.createDataFrame([("base", 0, None, base, None)], ENTRIES)
    write_json_lines(dense.unionAll(own), f"{root}/entries")


def read_entries(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """What `write_entries` wrote, as catalogue (kind, path, ord) and segments (file, path, url, ord)."""
    rows = spark.read.schema(ENTRIES).json(f"{root}/entries")
    return (
        rows.filter(F.col("kind").isin(*KINDS)).select("kind", "path", "ord"),
        rows.filter("kind = 'segments'").select("file", "path", "url", "ord"),
    )


def entries_base(spark: SparkSession, root: str) -> str | None:
    """The base that a manifest in entries names."""
    return spark.read.schema(ENTRIES).json(f"{root}/entries").filter("kind = 'base'").first()["path"]


def write_table_catalog(catalog: DataFrame, path: str) -> None:
    """The JSON catalogue {table: [file, ...]} of the rows of a table catalogue."""
    def text() -> Iterator[str]:
        yield "{"
        kinds = [row["kind"] for row in catalog.select("kind").distinct().orderBy("kind").collect()]  # one per table
        for k, kind in enumerate(kinds):
            rows = placed(catalog).filter(F.col("kind") == kind)
            yield ", " if k else ""
            yield from _listed(kind, (row["path"] for row in _rows(rows, "ord", "path")))
        yield "}"

    write_text(catalog.sparkSession, path, text())


def merge_catalogs(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Union per kind, first occurrence wins, local entries before remote ones, order kept.

    Copies collapse before the shuffle. The new `ord` moves remote entries behind all local ones of their kind.
    """
    local, remote = placed(local), placed(remote)
    # one row for each of the few kinds
    ends = local.filter(F.col("kind").isin(*KINDS)).groupBy("kind").agg((F.max("ord") + 1).alias("_from"))
    moved = remote.join(F.broadcast(ends), "kind", "left").select(
        "kind", "path", (F.col("ord") + F.coalesce("_from", F.lit(0))).alias("ord")
    )
    both = local.select("kind", "path", "ord").unionAll(moved).filter("path is not null")
    return both.groupBy("kind", "path").agg(F.min("ord").alias("ord"))


def _segment_key() -> Column:
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("file", "path", "url")])


def merge_segments(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Segments by file, path or url; the later entry replaces, at the place of the first. No key: kept as is."""
    columns = [c for c in local.columns if c != "ord"]
    key = _segment_key()
    sides = local.withColumn("_side", F.lit(0)).unionByName(remote.withColumn("_side", F.lit(1)))
    place = F.struct("_side", "ord")
    keyed = sides.select(
        F.struct(*columns).alias("_segment"), place.alias("_place"), key.alias("_key"),
        F.when(key.isNull(), place).alias("_own"),
    )
    merged = keyed.groupBy("_key", "_own").agg(
        F.max_by("_segment", "_place").alias("_segment"), F.min("_place").alias("_place")
    )
    return merged.select("_segment.*", F.col("_place._side").alias("side"), F.col("_place.ord").alias("ord"))


def delta_counts(
    before: DataFrame | None, after: DataFrame, segments_before: DataFrame | None = None,
    segments_after: DataFrame | None = None,
) -> DataFrame:
    """C4: entries added per kind, segments included. Where there was no catalogue before (None), nothing counts."""
    kinds = after.sparkSession.createDataFrame([(k,) for k in COUNTED_KINDS], "kind string")
    if before is None:
        return kinds.select("kind", F.lit(0).cast("long").alias("added"))
    signed = before.select("kind", F.lit(-1).alias("n")).unionAll(after.select("kind", F.lit(1).alias("n")))
    for segments, n in ((segments_before, -1), (segments_after, 1)):
        if segments is not None:
            signed = signed.unionAll(segments.select(F.lit("segments").alias("kind"), F.lit(n).alias("n")))
    change = signed.groupBy("kind").agg(F.sum("n").alias("n"))
    return kinds.join(change, "kind", "left").select("kind", F.coalesce("n", F.lit(0).cast("long")).alias("added"))


def make_absolute(catalog: DataFrame, base: str) -> DataFrame:
    """Absolute paths without doubles, first occurrence kept; the base is recorded on every row."""
    moved = placed(catalog).withColumn("path", absolute_path(F.col("path"), base)).filter("path is not null")
    return moved.groupBy("kind", "path").agg(F.min("ord").alias("ord")).withColumn("base", F.lit(base))


def absolute_segments(segments: DataFrame, base: str) -> DataFrame:
    """C5 for segments: `file` becomes absolute, all else stays."""
    return segments.withColumn("file", absolute_path(F.col("file"), base))


def _remapped(df: DataFrame, column: str, wanted: Column, mapping: DataFrame, salts: int) -> DataFrame:
    keyed = df.withColumn("_old", F.when(wanted, F.col(column)))
    found = lookup_join(keyed, mapping.select(F.col("old").alias("_old"), F.col("new").alias("_new")), "_old", salts)
    return found.select(*[F.coalesce("_new", column).alias(c) if c == column else F.col(c) for c in df.columns])


def remap_paths(catalog: DataFrame, mapping: DataFrame, salts: int = 16) -> DataFrame:
    """`mapping` (old, new) applied to the paths of arrow, parquet and files; others, and paths it does not know, stay."""
    return _remapped(catalog, "path", F.col("kind").isin(*REMAPPED_KINDS), mapping, salts)


def remap_segments(segments: DataFrame, mapping: DataFrame, salts: int = 16) -> DataFrame:
    """C6 for segments: `mapping` applied to `file`."""
    return _remapped(segments, "file", F.lit(True), mapping, salts)


def absolute_tables(tables: DataFrame, base: str) -> DataFrame:
    """Table entries as absolute paths: below `base`, without the folder `data/` that may stand in front."""
    bare = F.regexp_replace("path", "^data/", "")
    return placed(tables).withColumn("path", absolute_path(bare, base))


def tables_or_fallback(tables: DataFrame, catalog: DataFrame) -> DataFrame:
    """The table catalogue, or when it has no row the Parquet list as files of storage_diffs."""
    parquet = placed(catalog).filter("kind = 'parquet'").select(F.lit("storage_diffs").alias("kind"), "path", "ord")
    tables = placed(tables)
    return tables.select("kind", "path", "ord").unionAll(parquet.where(~tables.exists()))
