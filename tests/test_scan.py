"""Running values spread over tasks: equal to the windows by device, with nine tenths of the rows on one device."""

import random

import pytest

from gaugeworks.operators import current, lateness, scan

ROWS = "device_id string, metric_id string, event_time_us long, value double, quality int, flags int, arrival long"


@pytest.fixture(scope="module")
def samples(spark):
    r = random.Random(8)
    rows = [("hot" if i % 10 else r.choice(["a", "b", None, "zz"]), r.choice(["x", "y.z", "other"]), i * 1000 + r.randint(-400_000, 0), None if r.random() < 0.2 else float(i), r.choice([0, 0, 0, 2]), 0, i) for i in range(4000)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, ROWS).repartition(3).cache()


def same(a, b):
    assert sorted(map(repr, (tuple(r) for r in a.collect()))) == sorted(map(repr, (tuple(r) for r in b.select(*(f"`{c}`" for c in a.columns)).collect())))


@pytest.fixture
def many(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_flags(spark, samples, many):
    named = samples.filter("device_id is not null")
    same(lateness.flag_late(samples, 100_000), scan.flag_late_spread(samples, 100_000))
    seeds = spark.createDataFrame([("hot", 2_000_000), ("gone", 1)], "device_id string, seed_us long")
    same(lateness.flag_late(named, 100_000, seeds), scan.flag_late_spread(named, 100_000, seeds))
    assert scan.flag_late_spread(samples, 100_000).filter("flags = 2").count() > 100


def test_current_values(samples, many):
    same(current.current_values(samples, ["x", "y.z"]), scan.current_values_spread(samples, ["x", "y.z"]))


def test_spread(samples, many):
    """The hot device lies in most of the parts, and no part has much more than its share."""
    sizes = [r["count"] for r in scan.parts(samples, "arrival").groupBy("part").count().collect()]
    hot = scan.parts(samples, "arrival").filter("device_id = 'hot'").select("part").distinct().count()
    assert len(sizes) == 16 and max(sizes) < 3 * 4000 / 16 and hot >= 13


def test_no_rows(samples):
    assert scan.flag_late_spread(samples.limit(0), 5).count() == scan.current_values_spread(samples.limit(0), ["x"]).count() == 0
