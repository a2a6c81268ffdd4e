"""Every query with SQL gives the rows that DuckDB gives; every query runs and has the columns it had before."""

from __future__ import annotations

import os

import duckdb
import pytest

from tidewater import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLE = catalogue.queries(), catalogue.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toArrow()
    if name not in ORACLE:
        assert got.num_columns
        return
    want = duck.sql(ORACLE[name]).arrow()
    want = want.read_all() if hasattr(want, "read_all") else want
    assert sorted(got.column_names) == sorted(want.column_names)
    cols = sorted(got.column_names)
    rows = [sorted(tuple(map(str, map(plain, r))) for r in zip(*(t.column(c).to_pylist() for c in cols), strict=True)) for t in (got, want)]
    assert rows[0] == rows[1]
