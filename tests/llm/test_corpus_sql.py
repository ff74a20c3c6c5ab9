"""Queries with SQL against DuckDB over whole tables."""

import glob
import os

import duckdb
import pytest

from loomgraph.llm import queries


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(name, spark, sf, duck):
    df = queries.queries()[name](spark, sf)
    found = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(found.fetchall(), key=str)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)
    assert len(got) == len(want) and got == want
