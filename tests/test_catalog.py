"""File catalogues, named tables, reports, ad-hoc SQL."""

import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from statelake import schemas
from statelake.plans import catalog as cat, reports as rep, sql as q, tables as tab
from statelake.sinks import tables as out
from statelake.sources import arrow_ipc, generator

BASE = "https://h/data"


def listed(df, kind):
    return [r["path"] for r in df.filter(F.col("kind") == kind).orderBy("ord").collect()]


def make(spark, **kinds):
    rows = [(kind, path, i) for kind, paths in kinds.items() for i, path in enumerate(paths)]
    return spark.createDataFrame(rows, schemas.CATALOG)


def test_merge_keeps_order_and_first(spark):
    local = make(spark, arrow=["b", "a", "b"], files=["x"])
    remote = make(spark, arrow=["c", "a", "d", "c"], parquet=["p2", "p1"])
    merged = cat.merge_catalogs(local, remote)
    assert listed(merged, "arrow") == ["b", "a", "c", "d"]
    assert listed(merged, "parquet") == ["p2", "p1"] and listed(merged, "files") == ["x"]
    assert listed(cat.merge_catalogs(merged, local), "arrow") == ["b", "a", "c", "d"]
    added = {r["kind"]: r["added"] for r in cat.delta_counts(local, merged).collect()}
    assert added == {"arrow": 1, "parquet": 2, "files": 0, "segments": 0}
    assert {r["added"] for r in cat.delta_counts(None, merged).collect()} == {0}


def test_merge_segments(spark):
    def segments(*rows):
        return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "file string, path string, url string, note string, ord long")

    local = segments(("f", None, None, "old"), (None, None, None, "none 1"), ("", "p", None, "path"))
    remote = segments((None, None, "u", "url"), ("f", "p", None, "new"), (None, "", None, "none 2"))
    merged = cat.merge_segments(local, remote).orderBy("side", "ord").collect()
    assert [r["note"] for r in merged] == ["new", "none 1", "path", "url", "none 2"]


def test_read_manifest(spark, tmp_path):
    (tmp_path / "manifest.json").write_text(json.dumps(
        {"base": "b", "arrow": ["x", None, "y"], "files": None, "parquet": [], "segments": [{"file": "f", "n": 1}, None, {"url": "u"}]}
    ))
    catalog, segments = cat.read_manifest(spark, str(tmp_path / "manifest.json"))
    assert listed(catalog, "arrow") == ["x", "y"] and catalog.count() == 2
    assert [tuple(r)[:3] for r in segments.orderBy("ord").collect()] == [("f", None, None), (None, None, "u")]


def test_absolute_and_remap(spark):
    catalog = make(spark, arrow=["./a", "/a", BASE + "/a", "http://o/b", None], parquet=["a"])
    moved = cat.make_absolute(catalog, BASE + "/")
    assert listed(moved, "arrow") == [BASE + "/a", "http://o/b"] and listed(moved, "parquet") == [BASE + "/a"]
    assert {r["base"] for r in moved.collect()} == {BASE + "/"}
    mapping = spark.createDataFrame([(BASE + "/a", "objects/1.arrow")], "old string, new string")
    assert listed(cat.remap_paths(moved, mapping), "arrow") == ["objects/1.arrow", "http://o/b"]
    urls = make(spark, urls=[BASE + "/a"], files=[BASE + "/a"])
    assert listed(cat.remap_paths(urls, mapping), "urls") == [BASE + "/a"]
    assert listed(cat.remap_paths(urls, mapping), "files") == ["objects/1.arrow"]
    segments = spark.createDataFrame([("a", "p", 0), (None, "q", 1)], "file string, path string, ord long")
    there = cat.remap_segments(cat.absolute_segments(segments, BASE), mapping)
    assert [r[:2] for r in sorted(map(tuple, there.collect()), key=lambda r: r[2])] == [("objects/1.arrow", "p"), (None, "q")]
    tables = spark.createDataFrame([("nonces", "data/n/1"), ("nonces", "https://o/2"), ("nonces", "./n/3")], "kind string, path string")
    assert sorted(r["path"] for r in cat.absolute_tables(tables, BASE).collect()) == [BASE + "/n/1", BASE + "/n/3", "https://o/2"]


def test_catalogues_fit_together(spark, tmp_path):
    """What is built, merged and written is read again, without numbers added by hand."""
    for name in ("b.arrow", "a.arrow"):
        (tmp_path / name).write_text("x")
    built = cat.build_catalog(spark, str(tmp_path))
    merged = cat.merge_catalogs(built, built.drop("ord").unionAll(spark.createDataFrame([("arrow", "0.arrow")], "kind string, path string")))
    cat.write_manifest(merged, None, str(tmp_path / "manifest.json"), cat.merged_base("here", "there"))
    cat.write_manifest(merged, None, str(tmp_path / "manifest.json"), cat.merged_base("here", None))
    catalog, segments = cat.read_manifest(spark, str(tmp_path / "manifest.json"))
    assert listed(catalog, "arrow") == ["a.arrow", "b.arrow", "0.arrow"] and segments.count() == 0
    assert cat.manifest_base(spark, str(tmp_path / "manifest.json")) == "here"
    spark.createDataFrame([("0x1", "0x2", "f")], schemas.NONCES).write.parquet(str(tmp_path / "n"))
    cat.write_table_catalog(spark.createDataFrame([("nonces", str(tmp_path / "n"))], "kind string, path string"), str(tmp_path / "_tables.json"))
    assert tab.register_tables(spark, tab.read_table_catalog(spark, [str(tmp_path)]).drop("ord"))["nonces"] == 1


def test_fallback(spark):
    catalog = make(spark, parquet=["p", "q"], arrow=["a"])
    assert listed(cat.tables_or_fallback(make(spark, nonces=["n"]), catalog), "storage_diffs") == []
    assert listed(cat.tables_or_fallback(spark.createDataFrame([], schemas.CATALOG), catalog), "storage_diffs") == ["p", "q"]


def test_build(spark, tmp_path):
    for name in ("a.arrow", "sub/B.IPC", "sub/deep/c.feather", "p.parquet", "x.json"):
        (tmp_path / "data" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "data" / name).write_text("no such content is read")

    def built(**options):
        return sorted(tuple(r) for r in cat.build_catalog(spark, str(tmp_path / "data"), **options).collect())

    arrow = [("arrow", "a.arrow", 0), ("arrow", "sub/B.IPC", 0), ("arrow", "sub/deep/c.feather", 0)]
    assert built() == arrow
    assert built(include_parquet=True) == [*arrow, ("parquet", "p.parquet", 0)]


def test_table_catalog_of_first_root(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tab.read_table_catalog(spark, [str(tmp_path / "none")])
    spark.createDataFrame([("0x1", "0x2", "f")], schemas.NONCES).write.parquet(str(tmp_path / "n"))
    (tmp_path / "_tables.json").write_text(json.dumps({"nonces": [str(tmp_path / "n"), None], "storage_diffs": []}, indent=2))
    catalog = tab.read_table_catalog(spark, [str(tmp_path / "none"), str(tmp_path)])
    assert [tuple(r) for r in catalog.collect()] == [("nonces", str(tmp_path / "n"), 0)]
    assert tab.register_tables(spark, catalog) == {"storage_diffs": 0, "declared_classes": 0, "deployed_or_replaced": 0, "nonces": 1}
    assert spark.table("storage_diffs").schema == schemas.STORAGE_DIFFS and spark.table("storage_diffs").count() == 0
    assert spark.table("nonces").first()["nonce"] == "0x2"


def test_state_of_many_sources(spark, tmp_path):
    state = generator.generate_state(spark, 40, 3)
    parts = [state.filter(F.col("blob_index") == i) for i in (1, 2, 3)]
    parts[0].write.parquet(str(tmp_path / "tree/a/b"))
    arrow_ipc.write_arrow(parts[1], str(tmp_path / "arrow"))
    both = tab.state_of(spark, [str(tmp_path / "tree/a/b")], [str(tmp_path / "arrow")], [parts[2]])
    assert both.schema == schemas.STATE and both.exceptAll(state).count() == 0 and both.count() == 120
    assert tab.read_parquet(spark, str(tmp_path / "tree"), recursive=True).count() == 40
    assert tab.prefer_parquet(spark, [str(tmp_path / "tree/a/b")], [str(tmp_path / "arrow")]).select("blob_index").distinct().first()[0] == 1
    assert tab.prefer_parquet(spark, [], [str(tmp_path / "arrow")]).select("blob_index").distinct().first()[0] == 2
    with pytest.raises(ValueError):
        tab.prefer_parquet(spark, [], [])
    assert tab.state_of(spark).count() == 0


def test_unsigned_time_that_does_not_fit_stops(spark, tmp_path):
    spark.range(1).selectExpr("cast(9223372036854775808 as decimal(20,0)) as timestamp").write.parquet(str(tmp_path / "t"))
    with pytest.raises(Exception, match="OVERFLOW"):
        tab.read_parquet(spark, str(tmp_path / "t"), schema=schemas.STATE).collect()


def test_sinks(spark, tmp_path):
    state = generator.generate_state(spark, 100, 2, timestamp=1754784000)
    out.write_state(state, str(tmp_path / "lake"), 167001, max_records_per_file=30)
    back = spark.read.schema(schemas.STATE_PARTITIONED).parquet(str(tmp_path / "lake"))
    assert back.select("chain_id", "date", "topic").distinct().collect() == [(167001, 20310, "state_diff")]
    assert back.count() == 200 and (tmp_path / "lake/chain_id=167001/date=20310/topic=state_diff").is_dir()
    assert len(back.inputFiles()) >= 7
    out.write_state(state.repartition(7), str(tmp_path / "ordered"), 1, row_group_bytes=4096)
    for name in (tmp_path / "ordered").rglob("*.parquet"):
        rows = pq.read_table(name, columns=["blob_index", "position"]).to_pylist()
        assert rows == sorted(rows, key=lambda r: (r["blob_index"], r["position"]))
    out.write_table(state, str(tmp_path / "t"))
    out.write_table(state, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 400
    out.write_table(state, str(tmp_path / "t"), mode="overwrite")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 200
    out.write_empty(spark, schemas.STATE, str(tmp_path / "none"))
    assert spark.read.parquet(str(tmp_path / "none")).schema == schemas.STATE
    out.write_json_lines(spark.createDataFrame([("1", None), ("2", "3")], "addr string, nonce string"), str(tmp_path / "j"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "j")).collect()) == ['{"addr":"1"}', '{"addr":"2","nonce":"3"}']


def test_reports(spark):
    deployed = spark.createDataFrame([("a", "0x1")] * 3 + [("b", "0x2")] * 3 + [("c", "0x9")] * 9 + [("d", None)], "address string, class_hash string")
    wallets = spark.createDataFrame([("0x1", "Z"), ("0x2", "Y")], schemas.WALLET_MAP)
    share = rep.share_of_shown(rep.wallet_share(deployed, wallets), "cnt").collect()
    assert [tuple(r) for r in share] == [("Y", 3, 50.0), ("Z", 3, 50.0)]
    assert rep.share_of_shown(spark.createDataFrame([("a", 0)], "l string, v long"), "v").first()["pct"] == 0.0
    diffs = spark.createDataFrame([("0x1",), ("0X1",), (None,), ("0x2",)], "address string")
    assert [tuple(r) for r in rep.top_writers(diffs).collect()] == [("0x2", 1)]
    nonces = spark.createDataFrame([("a", "0x9"), ("a", "0x10"), (None, "0x1")], "contract_address string, nonce string")
    assert [tuple(r) for r in rep.latest_nonce_text(nonces).collect()] == [("a", "0x9"), (None, "0x1")]
    assert dict(rep.latest_nonce_numeric(nonces).filter("contract_address = 'a'").collect()) == {"a": "0x10"}
    assert rep.class_ranking(deployed, 2).collect()[0] == ("0x9", 9)
    assert rep.listing(nonces, ["contract_address", "nonce"], 1).collect() == [("a", "0x10")]


def test_wallet_overlay(spark):
    seed = rep.seed_wallets(spark)
    first = rep.SEED_WALLETS[0][0]
    external = spark.createDataFrame([
        ("0x" + first[2:].upper(), " Mine ", 1), ("0xA", "Old", 1), ("0xa", "New", 2), ("0xa", " UNKNOWN\t", 3), ("0xb", " ", 1),
        ("0Xc", "no", 1), (None, "no", 1), ("0xd", None, 1),
    ], "class_hash string, wallet string, ord int")
    found = dict(rep.overlay_wallets(seed, external).collect())
    assert found == {**dict(rep.SEED_WALLETS), first: "Mine", "0xa": "New"}


def test_sql(spark):
    spark.createDataFrame([(1, b"\x01"), (2, None)], "a int, b binary").createOrReplaceTempView("sql_t")
    result = q.run_sql(spark, "  select * from sql_t order by a ; ", None)
    assert (result.columns, result.rows, result.row_count, result.complete) == (["a", "b"], [[1, "0x01"], [2, None]], 2, True)
    cut = q.run_sql(spark, "select * from sql_t order by a", limit=1)
    assert (cut.rows, cut.complete) == ([[1, "0x01"]], False)
    for text in ("", " ; ", None):
        with pytest.raises(q.QueryError, match="empty"):
            q.run_sql(spark, text, None)
    for text in ("selec 1", "select * from no_such_table", "select 1/0"):
        with pytest.raises(q.QueryError, match="failed"):
            q.run_sql(spark, text, None)
    q.run_sql(spark, "create or replace temp view v as select 1 as one", None)
    assert q.run_sql(spark, "with x as (select * from v) select one from x", None).rows == [[1]]


def test_entries_are_dense_in_order(spark, tmp_path):
    rows = [("arrow", f"p{i}", (i * 37) % 1000) for i in range(500)] + [("urls", "u", 5), ("other", "x", 1), ("files", None, 2)]
    shuffled = spark.createDataFrame(rows, schemas.CATALOG).repartition(5)
    some = spark.createDataFrame([(None, "b", None, 2), ("f", None, None, 1), (None, None, "u", 9)], schemas.SEGMENTS)
    cat.write_entries(shuffled, some, str(tmp_path / "m"), base=None)
    paths, segments = cat.read_entries(spark, str(tmp_path / "m"))
    wanted = [(k, p, n) for n, (k, p, _) in enumerate(sorted((r for r in rows if r[0] == "arrow"), key=lambda r: (r[2], r[1])))]
    assert sorted(map(tuple, paths.collect()), key=lambda r: (r[0], r[2])) == [*wanted, ("urls", "u", 0)]
    assert [tuple(r) for r in segments.orderBy("ord").collect()] == [("f", None, None, 0), (None, "b", None, 1), (None, None, "u", 2)]
    assert cat.entries_base(spark, str(tmp_path / "m")) is None
    cat.write_entries(shuffled.limit(0), None, str(tmp_path / "n"), base="https://x")
    assert cat.read_entries(spark, str(tmp_path / "n"))[0].count() == 0 and cat.entries_base(spark, str(tmp_path / "n")) == "https://x"
