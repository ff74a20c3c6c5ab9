"""Every registered query with SQL against DuckDB; the others for their rows."""

import glob
import math
import os

import duckdb
import pytest

from loomgraph.plans import registry


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(name, spark, sf, duck):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(normal(r[c]) for c in cols) for r in df.collect()), key=str)
    found = duck.execute(registry.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(normal(r[i]) for i in at) for r in found.fetchall()), key=str)
    assert len(got) == len(want) and got == want


# fits and communities are tested on small graphs in test_graph.py and test_fits.py, and below on empty tables
@pytest.mark.parametrize("name", sorted(n for n in set(registry.QUERIES) - set(registry.ORACLE) if not n.startswith("fit_") and "communities" not in n))
def test_query_gives_rows(name, spark, sf):
    assert registry.QUERIES[name](spark, sf).count() > 0


@pytest.fixture(scope="module")
def no_rows(spark, sf, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for f in glob.glob(f"{sf}/*.parquet"):
        spark.read.parquet(f).limit(0).write.parquet(f"{folder}/{os.path.basename(f)}")
    return folder


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_of_empty_tables(name, spark, no_rows):
    rows = registry.QUERIES[name](spark, no_rows).collect()
    assert len(rows) <= 4  # scores of nothing are one row, quantiles one for each share
