"""Every query against its SQL in DuckDB, on the smallest tables."""

import datetime as dt
import decimal
import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tallymark import bench_queries as B

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).parents[1]


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (decimal.Decimal, float)):
        return None if math.isnan(v) else float(f"{float(v):.9g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v if isinstance(v, int) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(B.QUERIES))
def test_query(spark, duck, name):
    df = B.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in B.ORACLE_SQL:
        assert got
        return
    want = duck.sql(B.ORACLE_SQL[name])
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in place) for r in want.fetchall()), key=repr)


def test_entry_imports_without_a_session_and_without_the_optional_parts(tmp_path):
    for f in ("__spark_entry__.py", "tallymark"):
        (tmp_path / f).symlink_to(ROOT / f) if f.endswith(".py") else None
    (tmp_path / "tallymark").mkdir()
    for p in (ROOT / "tallymark").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "tallymark" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code.replace("startswith('op')", "startswith(('op1_', 'op2_', 'op3_'))")], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
