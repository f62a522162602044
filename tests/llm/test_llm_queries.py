import os

import duckdb
import pytest

from loomdial.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    rows = [tuple(str(x) for x in r) for r in QUERIES[name](spark, data).collect()]
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
    if name in ORACLE:
        c = duckdb.connect()
        c.execute("set timezone='UTC'")
        for f in os.listdir(data):
            c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{data}/{f}')")
        assert sorted(rows) == sorted(tuple(str(x) for x in r) for r in c.execute(ORACLE[name]).fetchall())
