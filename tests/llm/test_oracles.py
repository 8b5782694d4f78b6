"""Queries of the corpus operators that have SQL give the same rows as DuckDB."""

import glob
import os

import pytest

from foldlog.llm import entry

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(entry.ORACLE_SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df, want = entry.QUERIES[name](spark, DATA), con.sql(entry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in sorted(want.columns)]
    got = sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    assert got == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())
