"""Every query with SQL against the same tables in another engine."""

import glob
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    return round(float(v), 6) if isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equal(spark, tables, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rel = tables.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    order = lambda t: tuple((x is None, str(x)) for x in t)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=order)
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=order)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    df = entry.queries()[name](spark, DATA)
    assert df.columns and len(df.collect()) > 0


def test_entry(spark):
    if os.path.isdir(DATA):
        assert entry.entry(spark).count() > 0
