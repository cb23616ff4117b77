import datetime as dt
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from millrace.plans.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, (int, float)):
        return f"{v:.9g}"
    return v.isoformat() if isinstance(v, dt.datetime) else str(v)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n in entry.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    found = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    names = sorted(found.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(n) for n in names]
    got = sorted(tuple(plain(r[n]) for n in names) for r in found.collect())
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
