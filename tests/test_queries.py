"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")
CORE = [n for n in entry.oracle_sql() if not entry.queries()[n].__module__.startswith("quern.llm")]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", CORE)
def test_like_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    wanted = sorted(repr([plain(dict(zip(columns, r))[c]) for c in sorted(columns)]) for r in result.fetchall())
    assert sorted(columns) == sorted(df.columns) and got == wanted


def test_entry(spark):
    assert entry.entry(spark).count() > 0
