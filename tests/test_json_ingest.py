"""Decoded JSON: file shapes, flattening, the incremental store."""

import json

import pytest
from pyspark.sql import functions as F

from statelake import schemas
from statelake.operators import flatten as fl, increments, sizing
from statelake.plans.tables import register_tables
from statelake.sinks.diff_store import DiffStore
from statelake.sources import decoded_json as dj


def diff(address, *entries):
    return {"storage_diffs": [{"address": address, "storage_entries": [{"key": k, "value": v} for k, v in entries]}]}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_file_shapes(spark, tmp_path):
    one, two = diff("0x0A", ("0x01", "0x00")), diff("0x0B", ("0x2", None))
    (tmp_path / "object one.json").write_text(json.dumps(one))
    (tmp_path / "pretty.json").write_text(json.dumps(one, indent=2))
    (tmp_path / "array+x.JSON").write_text(json.dumps([one, 5, "x", None, [1], two], indent=1))
    (tmp_path / "lines%20.txt").write_text(json.dumps(one) + "\n\n  " + json.dumps(two) + "\r\n")
    (tmp_path / "empty.TXT").write_text(" \n ")
    (tmp_path / "other.csv").write_text("ignored")
    documents = dj.read_documents(spark, str(tmp_path), schemas.DIFF_DOCUMENT)
    a, b = ("0xa", "0x1", "0x0"), ("0xb", "0x2", None)
    expected = [(*a, "object one.json"), (*a, "pretty.json"), (*a, "array+x.JSON"), (*b, "array+x.JSON"), (*a, "lines%20.txt"), (*b, "lines%20.txt")]
    found = [tuple(r) for r in fl.storage_diffs(documents).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("text", ["{bad", '{"storage_diffs": "x"}', "3", '{"a": 1}\n{bad}'])
def test_bad_documents_stop_the_job(spark, text):
    df = spark.createDataFrame([("f", text)], "src string, text string")
    with pytest.raises(Exception):
        fl.storage_diffs(dj.documents_in(df, schemas.DIFF_DOCUMENT)).collect()


def test_nulls_and_numbers(spark):
    document = {
        "storage_diffs": [None, {"address": None, "storage_entries": None}, {"address": "0x1", "storage_entries": []},
                          {"address": 2 ** 200, "storage_entries": [{"key": 1}]}],
        "declared_classes": [{"class_hash": "0x0C", "compiled_class_hash": None}], "deployed_or_replaced": None,
        "nonces": [{"contract_address": "0X1", "nonce": "0x00"}],
    }
    df = dj.documents_in(spark.createDataFrame([("f", json.dumps(document))], "src string, text string"), schemas.DIFF_DOCUMENT)
    assert rows(fl.storage_diffs(df)) == [(str(2 ** 200), "1", None, "f")]
    assert rows(fl.declared_classes(df)) == [("0xc", None, "f")]
    assert rows(fl.deployed_or_replaced(df)) == []
    assert rows(fl.nonces(df)) == [("0X1", "0x0", "f")]


def test_contracts_and_index_map(spark):
    index = str(2 ** 127)
    document = {"contracts": [
        {"address": 2 ** 127, "class_hash": 5, "storage": [[1, 2], {"key": "007", "value": 2 ** 130}]},
        {"nonce": 0, "storage": [[2 ** 127 + 1, 3]]}, {"address": 4, "storage": None},
    ]}
    df = dj.documents_in(spark.createDataFrame([("f", json.dumps(document))], "src string, text string"), schemas.CONTRACTS_DOCUMENT)
    flat = fl.flatten_contracts(df)
    expected = [("0", str(2 ** 127 + 1), "3", None, "0"), (index, "1", "2", "5", None), (index, "7", str(2 ** 130), "5", None)]
    assert sorted((tuple(r) for r in flat.collect()), key=repr) == sorted(expected, key=repr)
    index_map = spark.createDataFrame([(index, "99"), ("1", "no literal is looked up"), ("7", "8")], schemas.INDEX_MAP)
    found = {(r["addr"], r["key"]) for r in fl.resolve_indexes(flat, index_map).collect()}
    assert found == {("0", str(2 ** 127 + 1)), ("99", "1"), ("99", "7")}


@pytest.mark.parametrize("bound", [0, sizing.MAX_ROWS])
def test_hot_surrogate(spark, monkeypatch, bound):
    monkeypatch.setattr(sizing, "MAX_ROWS", bound)
    hot = str(2 ** 128)
    flat = spark.range(3000).selectExpr(f"if(id % 3 = 0, '{hot}', cast(id as string)) as addr", "cast(id as string) as key")
    index_map = spark.createDataFrame([(hot, "777777")], schemas.INDEX_MAP)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = fl.resolve_indexes(flat, index_map)
        assert found.filter("addr = '777777'").count() == 1000 and found.count() == 3000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bad_pair_stops_the_job(spark):
    for pair in ("5", "null", "[1]", "[]", "[1, 2, 3]"):
        text = '{"contracts": [{"storage": [%s]}]}' % pair
        df = dj.documents_in(spark.createDataFrame([("f", text)], "src string, text string"), schemas.CONTRACTS_DOCUMENT)
        with pytest.raises(Exception, match="not a storage pair"):
            fl.flatten_contracts(df).collect()


def test_store(spark, tmp_path):
    source, root = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    store = DiffStore(spark, str(root))
    (source / "a.json").write_text(json.dumps(diff("0x1", ("0x1", "0x1"), ("0x2", "0x2"))))
    (source / "b.json").write_text(json.dumps([{"nonces": [{"contract_address": "0x1", "nonce": "0x05"}]}]))
    assert store.ingest(str(source)) == 2
    assert store.ingest(str(source)) == 0
    assert sorted((r["name"], r["written"]) for r in store.ledger().collect()) == [("a.json", 2), ("b.json", 1)]

    (source / "a.json").write_text(json.dumps(diff("0x1", ("0x1", "0x9"))))
    (source / "c.json").write_text("{}")
    assert store.ingest(str(source)) == 2
    assert rows(store.read("storage_diffs").select("key", "value")) == [("0x1", "0x1"), ("0x1", "0x9"), ("0x2", "0x2")]
    assert rows(store.read("storage_diffs", replace_by_src=True).select("key", "value")) == [("0x1", "0x9")]
    assert rows(store.read("nonces", replace_by_src=True)) == [("0x1", "0x5", "b.json")]
    assert {r["name"]: r["written"] for r in store.ledger().filter("batch = 2").collect()} == {"a.json": 1, "c.json": 0}
    assert store.ingest(str(source), force=True) == 3

    names = store.catalog()
    assert {r["kind"] for r in names.collect()} >= {"storage_diffs", "nonces"}
    counts = register_tables(spark, names)
    assert counts["storage_diffs"] >= 2
    assert spark.table("storage_diffs").count() == store.read("storage_diffs").count()


def test_unpublished_batch_does_not_count(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(diff("0x1", ("0x1", "0x1"))))
    store = DiffStore(spark, str(tmp_path / "out"))
    store.ingest(str(tmp_path / "in"))
    # tables of batch 2 were written, then the job died before the ledger
    store.read("storage_diffs").write.parquet(str(tmp_path / "out/tables/storage_diffs/batch=2"))
    assert store.read("storage_diffs").count() == 1
    (tmp_path / "in" / "b.json").write_text(json.dumps(diff("0x2", ("0x1", "0x1"))))
    store.ingest(str(tmp_path / "in"))
    assert rows(store.read("storage_diffs").select("address")) == [("0x1",), ("0x2",)]


def test_row_limit_per_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(diff("0x1", *[(str(i), "0x1") for i in range(25)])))
    store = DiffStore(spark, str(tmp_path / "out"))
    store.ingest(str(tmp_path / "in"), max_records_per_file=10)
    assert len(store.read("storage_diffs").inputFiles()) == 3


def test_increments(spark, tmp_path):
    for name, text in (("a.json", "1"), ("b.json", "2")):
        (tmp_path / name).write_text(text)
    files = increments.file_digests(spark, str(tmp_path))
    ledger = spark.createDataFrame([("a.json", "356a192b7913b04c54574d18c28d46e6395428ab"), ("b.json", "old")], "name string, sha1 string")
    assert [r["name"] for r in increments.new_files(files, ledger).collect()] == ["b.json"]
    assert increments.new_files(files, ledger, force=True).count() == 2
    done = spark.createDataFrame([("/out/a.arrow",)], "path string")
    assert [r["name"] for r in increments.without_output(files, done).collect()] == ["b.json"]


def test_digests_of_whole_and_streamed_files(spark, tmp_path):
    import hashlib

    contents = {"b.bin": b"x" * 100, "c d.bin": bytes(range(256)) * 4000}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "empty.bin").write_bytes(b"")  # Spark lists no empty files
    for bound in (0, 100, 1 << 30):
        found = {r["name"]: r["sha1"] for r in increments.file_digests(spark, str(tmp_path), "*.bin", whole_bytes=bound).collect()}
        assert found == {n: hashlib.sha1(c).hexdigest() for n, c in contents.items()}
