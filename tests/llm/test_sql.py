import os

import duckdb
import pytest

from sondage.llm.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = con.sql(ORACLES[name])
    df = QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(want.columns)
    own = [want.columns.index(c) for c in df.columns]
    assert sorted((tuple(r) for r in df.collect()), key=str) == sorted((tuple(r[i] for i in own) for r in want.fetchall()), key=str)
