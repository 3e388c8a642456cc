"""Every query that has SQL against DuckDB on the smallest tables, and the shape of a few plans."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.plans import queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"create view {f[:-8]} as select * from '{DIR}/{f}'")
    return c


def rows(df):
    plain = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 9) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ in ("float64", "int64", "int32", "Decimal") else str(v)
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_against_sql(spark, con, name):
    assert rows(queries.QUERIES[name](spark, DIR).toPandas()) == rows(con.sql(queries.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, DIR).count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    plan = queries.QUERIES["A19_cache_stats"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,signup)" in plan and "value" not in plan.split("ReadSchema")[1]


def test_pairing_is_one_equi_join(spark):
    from tallyframe.operators import compare
    from tallyframe.plans.views import view

    plan = compare.pair(view(spark, DIR, "v_side_b"), view(spark, DIR, "v_side_c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and "case_key" in plan and F is not None
