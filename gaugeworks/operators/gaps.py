"""Missing intervals of a series and the points that fill them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators.dedup import emission_order
from gaugeworks.operators.dims import small
from gaugeworks.operators.lateness import LATE, SYNTHETIC

POINTS = 4096


def steps(samples: DataFrame, metrics: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Neighbouring valid rows of each series: device_id, metric_id, prev_t, prev_v, t, v, and the metric's settings.

    Valid rows have a value and no device error; at one time the first counts, and late rows don't. seeds: device_id,
    metric_id, event_time_us, value of the newest stored row."""
    rows = samples.filter((F.col("value").isNotNull()) & (F.col("quality") != 2) & (F.col("flags").bitwiseAND(F.lit(LATE)) == 0))
    rows = rows.select("device_id", "metric_id", "event_time_us", "value", "sequence", "arrival")
    if seeds is not None:
        rows = rows.unionByName(seeds.select("device_id", "metric_id", "event_time_us", "value", F.lit(None).cast("bigint").alias("sequence"), F.lit(-1).cast("bigint").alias("arrival")))
    series = Window.partitionBy("device_id", "metric_id").orderBy(*emission_order())
    before = F.lag(F.struct("event_time_us", "value")).over(series)
    rows = rows.withColumn("__prev", before).filter("__prev is null or __prev.event_time_us < event_time_us")
    w = Window.partitionBy("device_id", "metric_id").orderBy("event_time_us")
    rows = rows.withColumn("__prev", F.lag(F.struct("event_time_us", "value")).over(w)).filter("__prev is not null")
    pairs = rows.select("device_id", "metric_id", F.col("__prev.event_time_us").alias("prev_t"), F.col("__prev.value").alias("prev_v"), F.col("event_time_us").alias("t"), F.col("value").alias("v"))
    known = metrics.filter("expected_period_us is not null").select("metric_id", "expected_period_us", "jitter_us", "max_gap_us", "interpolation")
    return pairs.join(small(known), "metric_id").filter("t - prev_t > expected_period_us + jitter_us")


def intervals(found: DataFrame) -> DataFrame:
    """device_id, metric_id, start_us, end_us, expected_count."""
    count = F.expr("(t - prev_t) div expected_period_us")
    return found.select("device_id", "metric_id", F.col("prev_t").alias("start_us"), F.col("t").alias("end_us"), F.when(count > 0, count - 1).otherwise(F.lit(0)).cast("bigint").alias("expected_count"))


def interpolate(found: DataFrame) -> DataFrame:
    """device_id, metric_id, event_time_us, value, quality, flags of the synthetic points."""
    fits = found.filter("interpolation <> 'none' and (max_gap_us is null or t - prev_t <= max_gap_us) and prev_t + expected_period_us < t")
    # a gap of any length is made in two steps, of arrays of bounded size
    numbered = fits.withColumn("__n", F.expr("(t - 1 - prev_t) div expected_period_us"))
    numbered = numbered.withColumn("__part", F.explode(F.expr(f"sequence(0, (__n - 1) div {POINTS})")))
    numbered = numbered.withColumn("__k", F.explode(F.expr(f"sequence(__part * {POINTS} + 1, least(__n, (__part + 1) * {POINTS}))")))
    points = numbered.withColumn("at", F.col("prev_t") + F.col("__k") * F.col("expected_period_us"))
    share = (F.col("at") - F.col("prev_t")).cast("double") / (F.col("t") - F.col("prev_t")).cast("double")
    value = F.when(F.col("interpolation") == "previous", F.col("prev_v")).otherwise(F.col("prev_v") + (F.col("v") - F.col("prev_v")) * share)
    return points.select("device_id", "metric_id", F.col("at").alias("event_time_us"), value.alias("value"), F.lit(0).alias("quality"), F.lit(SYNTHETIC).alias("flags"))


def last_valid(stored: DataFrame) -> DataFrame:
    """The newest row with a value and without a device error of each series."""
    rows = stored.filter("value is not null and quality <> 2")
    return rows.groupBy("device_id", "metric_id").agg(F.max(F.struct("event_time_us", "value")).alias("last")).select("device_id", "metric_id", "last.*")
