import os

import duckdb
import pytest

from millrace.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    return "" if v is None else f"{v:.9g}" if isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for table in os.listdir(SF):
        con.execute(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{table}')")
    found, want = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    names = sorted(found.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(n) for n in names]
    assert sorted(tuple(plain(r[n]) for n in names) for r in found.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
