"""Exact quantiles in bounded memory against percentile_disc."""

import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import quantiles

FRACTIONS = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p0": 0.0, "p100": 1.0}


def expected(rows, keys):
    return rows.groupBy(*keys).agg(*(F.expr(f"percentile_disc({f}) WITHIN GROUP (ORDER BY v)").alias(n) for n, f in FRACTIONS.items()))


def same(a, b):
    assert sorted(map(repr, (tuple(r) for r in a.collect()))) == sorted(map(repr, (tuple(r) for r in b.select(*a.columns).collect())))


@pytest.mark.parametrize("accuracy", [10_000, 20, 2])
def test_against_percentile_disc(spark, accuracy):
    """Ties, skew, exponents far apart, nulls, null keys and empty groups; a coarse sketch changes nothing."""
    r = random.Random(accuracy)
    rows = [("hot", r.choice([r.gauss(0, 1), 10.0 ** r.randint(-300, 300), 7.0, 7.0])) for _ in range(9000)]
    rows += [(f"k{i % 50}", float(r.randint(0, 5))) for i in range(1000)] + [("one", 3.5), ("none", None), ("hot", None), (None, 1.0), (None, 2.0), ("inf", float("inf")), ("inf", float("-inf")), ("inf", 0.0)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(6)
    same(quantiles.exact_quantiles(frame, ["k"], "v", FRACTIONS, accuracy), expected(frame, ["k"]))


def test_no_rows(spark):
    assert quantiles.exact_quantiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", FRACTIONS).count() == 0


def test_plan_keeps_no_values(spark):
    """Nothing collects a group's values: counts are summed in the map tasks by group and value."""
    frame = spark.range(1000).selectExpr("id % 2 AS k", "cast(id AS double) AS v")
    plan = quantiles.exact_quantiles(frame, ["k"], "v", {"p50": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "collect_list" not in plan
