"""Complete sets and blob listings."""

import pytest

from statelake.operators import sets
from statelake.sources import blob_items as bi

ITEM = "eth_block long, tx_hash string, idx long, path string"


@pytest.mark.parametrize("size", [1, 2, 4096])
def test_complete_sets(spark, monkeypatch, size):
    monkeypatch.setattr(sets, "SLICE", size)
    groups = {
        "whole": [0, 1, 2], "one": [0], "gap": [0, 2], "late": [1, 2], "double": [0, 1, 1], "double_gap": [0, 0, 2],
        "large": list(range(50)), "negative": [-1, 0, 1],
    }
    rows = [(7, name, i, f"{name}-{n}") for name, indexes in groups.items() for n, i in enumerate(indexes)]
    complete = sets.complete_sets(spark.createDataFrame(rows, ITEM).repartition(5))
    found = sorted(tuple(r) for r in complete.collect())
    assert found == sorted(r for r in rows if r[1] in ("whole", "one", "large"))
    entries = sets.manifest_entries(complete).orderBy("position").collect()
    joined = {}
    for e in entries:
        joined.setdefault(e["tx_hash"], []).append(e["path"])
    assert joined["large"] == [f"large-{i}" for i in range(50)] and joined["whole"] == [f"whole-{i}" for i in range(3)]


def test_a_set_of_ten_thousand(spark):
    items = spark.range(10_000).selectExpr("1L as eth_block", "'a' as tx_hash", "id as idx", "concat('p', id) as path")
    entries = sets.manifest_entries(sets.complete_sets(items)).orderBy("position").collect()
    assert [(e.position, e.path) for e in entries] == [(k, f"p{k}") for k in range(10_000)]


def test_doubles_collapse_before_the_join(spark):
    text = sets.complete_sets(spark.createDataFrame([(1, "a", 0, "p")], ITEM))._jdf.queryExecution().executedPlan().toString()
    left = text[text.index("Join"):]
    assert left.index("partial_min(path") > left.index("Aggregate(key=[eth_block") > 0


def test_same_block_other_transaction(spark):
    rows = [(1, "a", 0, "p"), (1, "b", 1, "q"), (2, "a", 0, "r")]
    found = sets.complete_sets(spark.createDataFrame(rows, ITEM)).select("path").collect()
    assert sorted(r[0] for r in found) == ["p", "r"]


PAGES = [
    '{"items": [{"eth_block_number": 5, "tx_hash": "a", "index": 1, "timestamp": 10.9, "storageUrl": "u1"},'
    ' {"blockNumber": 6, "txHash": "b", "blockTimestamp": "1970-01-01T00:01:00Z", "storage": {"url": "u2"}}], "blobs": [{"storageUrl": "no"}]}',
    '{"blobs": [{"eth_block_number": 0, "blockNumber": 7, "tx_hash": "", "txHash": "c", "timestamp": "x", "time": "soon",'
    ' "dataStorageReferences": [null, {"url": ""}, {"url": "u3"}, {"url": "other"}], "storageUrl": "no"}]}',
    ' [{"dataStorageReferences": [], "data_storage_references": [{"url": "u4"}]}, {"storageUrl": ""}, {"blockNumber": 9}, null]',
    '{"items": null}', '{}',
]


def test_items(spark, tmp_path):
    for i, page in enumerate(PAGES):
        (tmp_path / f"{i}.json").write_text(page)
    found = sorted(tuple(r) for r in bi.read_items(spark, str(tmp_path)).collect())
    assert found == [
        (0, "", 0, None, True, "u4"), (5, "a", 1, 10, False, "u1"), (6, "b", 0, 60, False, "u2"), (7, "c", 0, None, True, "u3"),
    ]


def test_pages(spark):
    items = spark.createDataFrame([(b, f"t{b}", i, None, True, "u") for b in range(1, 6) for i in range(3)],
                                  "eth_block long, tx_hash string, idx long, timestamp long, timestamp_missing boolean, url string")

    def page(**options):
        return [(r["eth_block"], r["idx"]) for r in bi.page_of(items, **options).collect()]

    assert page(page_size=4) == [(5, 2), (5, 1), (5, 0), (4, 2)]
    assert page(page=2, page_size=4) == [(4, 1), (4, 0), (3, 2), (3, 1)]
    assert page(start_block=2, end_block=3, page_size=50, max_items=2) == [(3, 2), (3, 1)]
    assert page(page=9) == []
