"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from loomdial.plans.oracle import ORACLE
from loomdial.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(data):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{data}/{f}')")
    return c


def plain(v):
    if v is None or v != v:
        return (1, "")
    if isinstance(v, bool):
        return (0, str(v))
    try:
        return (0, f"{float(v):.8g}")
    except (TypeError, ValueError):
        return (0, str(v))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, con, data, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() >= 0
