"""Every query with SQL gives the same rows as DuckDB; the smallest tables suffice here."""

import glob
import os

import pytest

from foldlog.plans.log_queries import QUERIES as LOG_QUERIES
from foldlog.plans.queries import QUERIES as TABLE_QUERIES

QUERIES = TABLE_QUERIES | LOG_QUERIES

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        out.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return out


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, con, name):
    f, sql = QUERIES[name]
    df = f(spark, DATA)
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    got = sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))
    order = [want.columns.index(c) for c in sorted(want.columns)]
    assert got == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


def test_filters_reach_the_scan(spark):
    for name in ("scan_kind_scoped", "scan_after_mixed", "scan_overlap_dedup"):
        plan = QUERIES[name][0](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        pushed = plan[plan.index("PushedFilters") :]
        pushed = pushed.split("ReadSchema")[0]
        assert "EqualTo(event_type,purchase)" in pushed or "In(event_type" in pushed, name


def test_columns_are_pruned(spark):
    plan = QUERIES["proj_total_by_stream"][0](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan[plan.index("ReadSchema") :].split("\n")[0]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
