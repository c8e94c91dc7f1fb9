"""Every registered query beside its SQL, and what its plan must not hold."""

import re

import pytest
from compare import difference, duck

import __spark_entry__ as entry
from adhere.plans import oracle, registry

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython",
                     "MapInPandas", "ObjectHashAggregate(keys=[]"):
        assert unwanted not in plan
    assert difference(df, con, SQL[name]) is None


def test_entry(spark):
    assert not entry.entry(spark).isEmpty()


def test_dates_reach_the_scan(spark):
    plan = QUERIES["calendar_days"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet \[([^\]]*)\].*?PushedFilters: \[([^\]]*)\]", plan)
    events = [s for s in scans if "ts#" in s[0]]
    assert any("GreaterThanOrEqual(ts,2024-01-01T00:00)" in pushed for _, pushed in events)
    assert all("props" not in columns for columns, _ in events)


def test_past_reflections_do_not_read_the_events(spark):
    plan = QUERIES["past_reflections"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "events.parquet" not in plan and "documents.parquet" in plan
