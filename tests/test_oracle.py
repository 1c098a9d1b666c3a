"""Every registered query against its SQL counterpart."""

import os

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from statelake.plans.oracles import ORACLES
from statelake.plans.registry import QUERIES

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{ROOT}/{name}.parquet')")
    return connection


def test_same_names():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equal(name, spark, duck):
    df = QUERIES[name](spark, ROOT)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)

    def rows(columns, data):
        places = [columns.index(n) for n in order]
        return sorted((tuple(row[p] for p in places) for row in data), key=repr)

    assert rows(df.columns, df.collect()) == rows(names, found.fetchall())
