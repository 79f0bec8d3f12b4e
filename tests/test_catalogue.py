"""Every registered query of the telemetry engine that SQL can express, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from gaugeworks.plans.catalogue import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def plain(v):
    return (0.0 if v == 0 else v) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    names = sorted(frame.columns)
    found = duck.execute(ORACLES[name])
    theirs = [x[0] for x in found.description]
    assert sorted(theirs) == names
    want = sorted(repr([plain(r[theirs.index(n)]) for n in names]) for r in found.fetchall())
    assert sorted(repr([plain(v) for v in r]) for r in frame.select(*names).collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans(spark):
    """Filters and columns reach the scan; one shuffle for windows; broadcast joins for settings."""
    frame = QUERIES["window_stats_3600s"](spark, FOLDER)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "props" not in plan.split("ReadSchema")[-1].split("\n")[0]
    plan = QUERIES["samples_query"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(event_type,click)" in plan and "TakeOrderedAndProject" in plan
    plan = QUERIES["normalize_chain"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
