"""Every query with SQL against DuckDB on the smallest tables; every other query runs."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() else repr(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


#: Rounded values whose last digit may turn with the order of a sum.
CLOSE = {"cosine": 2e-6, "score": 2e-4, "coverage": 2e-6}


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = duck.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == cols
    exact = [c for c in cols if c not in CLOSE]
    got = sorted((tuple(plain(r[c]) for c in exact), [r[c] for c in cols if c in CLOSE]) for r in df.collect())
    want = sorted((tuple(plain(r[names.index(c)]) for c in exact), [r[names.index(c)] for c in cols if c in CLOSE]) for r in found.fetchall())
    assert [k for k, _ in got] == [k for k, _ in want]
    for (_, a), (_, b) in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=2e-4)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
