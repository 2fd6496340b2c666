"""Queries of the training-data operators against their SQL in DuckDB, on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from tallymark.llm.queries import ORACLE_SQL, QUERIES
from tests.test_queries import plain

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df, want = QUERIES[name](spark, DATA), con.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    place = [want.columns.index(c) for c in df.columns]
    got = sorted((tuple(plain(x) for x in r) for r in df.collect()), key=repr)
    assert got and got == sorted((tuple(plain(r[i]) for i in place) for r in want.fetchall()), key=repr)
