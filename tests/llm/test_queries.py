"""Registered llm queries on sf0.001: against DuckDB where SQL expresses them, else their contract."""

import os

import pytest

import __spark_entry__ as E
from histofold.llm.oracle import SQL
from histofold.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")


def plain(v):
    return tuple(v) if isinstance(v, list) else int(v) if isinstance(v, bool) else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(E.queries()) and {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.execute(SQL[name])
    names = [d[0] for d in rel.description]
    want = sorted((tuple(plain(dict(zip(names, r))[c]) for c in cols) for r in rel.fetchall()), key=repr)
    assert sorted(names) == cols
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_covers_every_document(spark, name):
    ids = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert {r["doc_id"] for r in QUERIES[name](spark, SF).select("doc_id").collect()} == ids
