"""Blob and Arrow files by the reader, by SQL and as a stream."""

import os
import re

import pytest
from pyspark.sql import functions as F

from statelake import fixtures as X, schemas
from statelake.sources import arrow_ipc, blob, formats
from statelake.streaming import jobs

from test_lww import collected

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def state(spark):
    formats.register(spark)
    return X.binary_state(X.state_events(spark, ROOT))


@pytest.fixture(scope="module")
def blobs(state, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("blobs") / "b")
    blob.write_blobs(state, where)
    return where


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reader_and_sql(spark, state, blobs):
    assert collected(spark.read.format("zkbl").load(blobs)) == collected(state)
    spark.sql(f"create or replace temporary view from_files using zkbl options (path '{blobs}')")
    got = spark.sql("select blob_index, count(*) as n from from_files where blob_index in (2, 5, 99) and position > 20 group by 1")
    assert collected(got) == collected(
        state.filter("blob_index in (2, 5) and position > 20").groupBy("blob_index").agg(F.count(F.lit(1)).alias("n"))
    )


@pytest.mark.parametrize("bound, files", [
    ("blob_index >= 28", 3), ("blob_index = 4", 1), ("blob_index > 3 and blob_index <= 5", 2), ("blob_index = 77", 0),
])
def test_pushed_bounds_leave_files_out(spark, state, blobs, bound, files):
    df = spark.read.format("zkbl").load(blobs).filter(bound)
    assert collected(df) == collected(state.filter(bound))
    assert df.rdd.getNumPartitions() == max(files, 1)
    assert not re.search(r"\bFilter \S", plan(df))  # all of it went into the source


def test_bounds_of_time_and_of_other_columns(spark, state, blobs):
    df = spark.read.format("zkbl").load(blobs)
    for bound in ("timestamp < 1704067201", "position between 100 and 300", "timestamp > 1705000000 and type = 'tx'", "key is null"):
        assert collected(df.filter(bound)) == collected(state.filter(bound)), bound


def test_bad_files(spark, state, blobs, tmp_path):
    good = sorted(f for f in os.listdir(blobs) if f.endswith(".gz"))[:2]
    for name in good:
        (tmp_path / name).write_bytes(open(f"{blobs}/{name}", "rb").read())
    (tmp_path / "cut_1.blob.gz").write_bytes(open(f"{blobs}/{good[0]}", "rb").read()[:-30])
    (tmp_path / "no_2.blob.gz").write_bytes(b"nothing")
    read = spark.read.format("zkbl").option("mode", "PERMISSIVE").load(str(tmp_path))
    assert read.count() == spark.read.format("zkbl").load([f"{blobs}/{good[0]}"][0]).count() + spark.read.format("zkbl").load(f"{blobs}/{good[1]}").count()
    with pytest.raises(Exception, match="no_2|cut_1"):
        spark.read.format("zkbl").load(str(tmp_path)).count()
    with pytest.raises(Exception, match="there is no"):
        spark.read.format("zkbl").load(str(tmp_path / "none")).count()


def test_stream(spark, state, blobs, tmp_path):
    names = sorted(f for f in os.listdir(blobs) if f.endswith(".gz"))
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    folder = tmp_path / "in"
    folder.mkdir()

    def run(some):
        for name in some:
            (folder / name).write_bytes(open(f"{blobs}/{name}", "rb").read())
        stream = spark.readStream.format("zkbl").option("settleSeconds", "0").load(str(folder))
        stream.writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out).awaitTermination()
        return spark.read.schema(schemas.STATE).parquet(out)

    assert run(names[:4]).select("blob_index").distinct().count() == 4
    assert collected(run(names[4:])) == collected(state)
    assert run([]).count() == state.count()


def test_arrow_files(spark, state, tmp_path):
    where = str(tmp_path / "a")
    arrow_ipc.write_arrow(state.repartition(3), where)
    df = spark.read.format("arrowfile").option("batchesPerTask", "1").load(where)
    assert collected(df) == collected(state)
    assert collected(df.filter("blob_index = 7 and position > 5")) == collected(state.filter("blob_index = 7 and position > 5"))
    some = spark.read.format("arrowfile").schema("key binary, blob_index long").load(where)
    assert collected(some) == collected(state.select("key", "blob_index"))
