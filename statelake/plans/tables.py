"""Tables over many files and named views."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from statelake import schemas
from statelake.sources.arrow_ipc import read_arrow
from statelake.sources.files import exists, manifest_text

VIEW = "state"

def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of `schema` in its order and types; a number that does not fit stops the job."""
    return df.select(*[
        F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def read_parquet(spark: SparkSession, path: str | list[str], recursive: bool = False, schema: T.StructType | None = None) -> DataFrame:
    """Files, folders or a whole tree; with a schema the columns are brought to it."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.parquet")
    df = reader.parquet(*([path] if isinstance(path, str) else path))
    return df if schema is None else conform(df, schema)


def state_of(
    spark: SparkSession, parquet: Iterable[str] = (), arrow: Iterable[str] = (), frames: Iterable[DataFrame] = ()
) -> DataFrame:
    """S3: one state table over Parquet files, Arrow files and other sources, UNION ALL."""
    parts = [conform(df, schemas.STATE) for df in frames]
    if parquet := list(parquet):
        parts.append(read_parquet(spark, parquet, schema=schemas.STATE))
    if arrow := list(arrow):
        parts.append(read_arrow(spark, arrow))
    result = spark.createDataFrame([], schemas.STATE) if not parts else parts[0]
    for part in parts[1:]:
        result = result.unionAll(part)
    return result


def prefer_parquet(spark: SparkSession, parquet: list[str], arrow: list[str]) -> DataFrame:
    """Parquet files when a manifest has some, else its Arrow files; neither is an error."""
    if not parquet and not arrow:
        raise ValueError("the manifest has neither parquet nor arrow files")
    return state_of(spark, parquet=parquet) if parquet else state_of(spark, arrow=arrow)


def read_table_catalog(spark: SparkSession, roots: list[str], name: str = "_tables.json") -> DataFrame:
    """(kind, path, ord) from the JSON catalogue {table: [file, ...]} of the first readable root."""
    listed = T.MapType(T.StringType(), T.ArrayType(T.StringType()))
    for root in roots:
        path = f"{root.rstrip('/')}/{name}"
        if exists(path):
            tables = manifest_text(spark, path).select(F.explode(F.from_json("value", listed)).alias("kind", "paths"))
            return tables.select("kind", F.posexplode("paths").alias("ord", "path")).filter("path is not null").select(
                "kind", "path", F.col("ord").cast("long").alias("ord")
            )
    raise FileNotFoundError(f"{name} in none of {roots}")


def register_tables(spark: SparkSession, catalog: DataFrame, base: str = "") -> dict[str, int]:
    """A view per state-diff table over its files, and an empty typed view where there is no file.

    Returns the number of files per view. A catalogue row is a path the reader is given anyway.
    """
    counts = {}
    for name, schema in schemas.DIFF_TABLES.items():
        order = [c for c in ("ord", "path") if c in catalog.columns]
        rows = catalog.filter(F.col("kind") == name).orderBy(*order).select("path").toLocalIterator()
        paths = [base + row["path"] for row in rows]
        df = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
        df.createOrReplaceTempView(name)
        counts[name] = len(paths)
    return counts
