"""Incremental store of decoded state diffs: four tables, a ledger and a catalogue."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from statelake import schemas
from statelake.operators.flatten import FLATTENERS
from statelake.operators.increments import file_digests, new_files
from statelake.sinks.tables import write_table
from statelake.sources.decoded_json import GLOB, read_documents
from statelake.sources.files import list_files

_BATCH = T.StructField("batch", T.LongType())


class DiffStore:
    """Tables below tables/<name>/batch=<n>/, ledger below ledger/batch=<n>/, one mark per batch below published/.

    The mark is written last and is one small file. Batches without a mark do not count, so the four tables and the
    ledger of a batch become visible together, and the rest of a failed run is overwritten by the next.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _load(self, path: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        """(name, sha1, written, batch); `written` counts the rows of all four tables."""
        return self._visible(self._load(f"{self.root}/ledger", T.StructType([*schemas.FILE_LEDGER.fields, _BATCH])))

    def ingest(self, source: str, force: bool = False, max_records_per_file: int = 0, layout: str = "auto") -> int:
        """Read the new or changed files of a folder; returns how many there were. `layout` as in read_documents."""
        fresh = new_files(file_digests(self.spark, source, GLOB), self.ledger(), force)
        batch = max(self._published(), default=0) + 1
        listing = f"{self.root}/pending/batch={batch}"
        fresh.write.mode("overwrite").parquet(listing)
        pending = self.spark.read.schema("path string, name string, sha1 string").parquet(listing)
        # one entry per new file, as in the listing the scan itself keeps
        paths = [row["path"] for row in pending.select("path").toLocalIterator()]
        if not paths:
            return 0
        # parsed once; each table then reads only its own nested column
        parsed = f"{self.root}/parsed/batch={batch}"
        documents = read_documents(self.spark, paths, schemas.DIFF_DOCUMENT, layout)
        write_table(documents, parsed, mode="overwrite")
        documents = self.spark.read.schema(documents.schema).parquet(parsed)
        for name, flatten in FLATTENERS.items():
            where = f"{self.root}/tables/{name}/batch={batch}"
            write_table(flatten(documents), where, mode="overwrite", max_records_per_file=max_records_per_file)
        counts = None
        for name in FLATTENERS:
            part = self._batches(name).filter(F.col("batch") == batch).groupBy(F.col("src").alias("name")).count()
            counts = part if counts is None else counts.unionAll(part)
        written = counts.groupBy("name").agg(F.sum("count").alias("written"))
        entries = pending.join(written, "name", "left").select(
            "name", "sha1", F.coalesce("written", F.lit(0).cast("long")).alias("written")
        )
        entries.write.mode("overwrite").parquet(f"{self.root}/ledger/batch={batch}")
        mark = self.spark.createDataFrame([(len(paths),)], "files long").coalesce(1)
        mark.write.mode("overwrite").parquet(f"{self.root}/published/batch={batch}")
        return len(paths)

    def _batches(self, table: str) -> DataFrame:
        return self._load(f"{self.root}/tables/{table}", T.StructType([*schemas.DIFF_TABLES[table].fields, _BATCH]))

    def _published(self) -> list[int]:
        # one number per ingest run
        marks = self._load(f"{self.root}/published", T.StructType([T.StructField("files", T.LongType()), _BATCH]))
        return [row["batch"] for row in marks.select("batch").distinct().collect()]

    def _visible(self, rows: DataFrame) -> DataFrame:
        return rows.filter(F.col("batch").isin(self._published()))

    def read(self, table: str, replace_by_src: bool = False) -> DataFrame:
        """Rows of all published batches, or with `replace_by_src` only those of each file's newest version."""
        rows = self._visible(self._batches(table))
        if replace_by_src:
            newest = self.ledger().groupBy("name").agg(F.max("batch").alias("newest"))
            old = self.ledger().join(newest, "name").filter("batch < newest").select(F.col("name").alias("src"), "batch")
            rows = rows.join(old, ["src", "batch"], "left_anti")
        return rows.select(*schemas.DIFF_TABLES[table].names)

    def catalog(self) -> DataFrame:
        """(kind, path, ord): the files of every table, from a listing alone; their order is that of the paths."""
        published = [f"batch={number}" for number in self._published()]
        files = list_files(self.spark, f"{self.root}/tables", "*.parquet", recursive=True)
        places = files.select("path", F.regexp_extract("path", "/tables/([^/]+)/(batch=[0-9]+)/", 1).alias("kind"),
                              F.regexp_extract("path", "/tables/([^/]+)/(batch=[0-9]+)/", 2).alias("folder"))
        return places.filter(F.col("folder").isin(published)).select("kind", "path", F.lit(0).cast("long").alias("ord"))
