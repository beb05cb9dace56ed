"""Every query with SQL against DuckDB at the smallest scale; the others run and return rows."""

import os

import duckdb
import numpy as np
import pytest

from tidemark import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def cell(v):
    if v is None or (isinstance(v, float) and np.isnan(v)):
        return None
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    return repr(float(v) + 0.0) if isinstance(v, (float, np.floating)) else str(v)


def rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(cell(v) for v in r) for r in df[names].itertuples(index=False)) if len(df) and not df[names].isna().any().any() else sorted(
        (tuple(cell(v) for v in r) for r in df[names].itertuples(index=False)), key=str
    )


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = rows(QUERIES[name](spark, DIR).toPandas()), rows(duck.execute(SQL[name]).df())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_returns_rows(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["month", "total", "active", "hhi", "entropy", "axis", "dominant"]
