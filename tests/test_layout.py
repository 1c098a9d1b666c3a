"""Layout along a curve: rows stay what they are, and bounds on any column skip most row groups."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from statelake.sinks import layout
from statelake.sinks.tables import write_table


def groups_met(path, column, low, high):
    """Row groups whose bounds meet [low, high], and all row groups."""
    met = total = 0
    for file in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        at = meta.schema.names.index(column)
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(at).statistics
            total += 1
            met += stats is None or not stats.has_min_max or (stats.min <= high and stats.max >= low)
    return met, total


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(200_000).selectExpr(
        "id", "pmod(xxhash64(id, 1), 10000) as blob_index", "pmod(xxhash64(id, 2), 3650) as day",
        "concat('0x', sha2(cast(id as string), 256)) as key", "if(id % 3 = 0, 7L, id) as skewed",
    )


def test_every_bound_skips(spark, rows, tmp_path):
    where, plain = str(tmp_path / "curve"), str(tmp_path / "sorted")
    layout.write_along_curve(rows, where, ["blob_index", "day", "key"], ranges=256)
    write_table(rows.repartitionByRange(64, "blob_index").sortWithinPartitions("blob_index"), plain)
    back = spark.read.parquet(where)
    assert back.dtypes == rows.dtypes and back.exceptAll(rows).count() == 0 and back.count() == 200_000
    for column, low, high in (("blob_index", 100, 199), ("day", 40, 70), ("key", "0x40", "0x41")):
        met, total = groups_met(where, column, low, high)
        assert total >= 240 and met <= 0.4 * total, (column, met, total)
    met, total = groups_met(plain, "day", 40, 70)
    assert met == total  # an order by one column helps no other


def test_hot_values_and_nulls(spark, rows, tmp_path):
    some = rows.limit(5000).withColumn("nothing", F.lit(None).cast("long")).withColumn("skewed", F.when(F.col("id") % 7 != 0, F.col("skewed")))
    steps = layout.quantile_steps(some, ["skewed", "nothing"])
    assert steps["nothing"] == [] and len(steps["skewed"]) == len(set(steps["skewed"])) <= 63
    layout.write_along_curve(some, str(tmp_path / "c"), ["skewed", "nothing", "key"], ranges=8)
    assert spark.read.parquet(str(tmp_path / "c")).exceptAll(some).count() == 0
    layout.write_along_curve(some.limit(0), str(tmp_path / "n"), ["skewed"], ranges=2)
    assert spark.read.schema(some.schema).parquet(str(tmp_path / "n")).count() == 0
