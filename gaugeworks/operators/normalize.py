"""Calibration, unit conversion and range check; a null value passes all three."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.units import converted
from gaugeworks.operators.dims import small


def calibrate(rows: DataFrame, calibrations: DataFrame) -> DataFrame:
    """rows (device_id, metric_id, value) with `calibrated` and `reject` (null, or why the row goes).

    A pair's segments travel as one small array, so the range join is a lookup by pair and keeps one row for each."""
    segments = calibrations.groupBy("device_id", "metric_id").agg(F.array_sort(F.collect_list(F.struct("seg_min", "seg_max", "slope", "intercept"))).alias("segments"), F.max("reject_unmatched").alias("reject_unmatched"))
    joined = rows.join(small(segments), ["device_id", "metric_id"], "left")
    hit = F.get(F.filter("segments", lambda s: (F.col("value") >= s["seg_min"]) & (F.col("value") < s["seg_max"])), F.lit(0))
    joined = joined.withColumn("hit", hit)
    out = F.when(F.col("hit").isNotNull(), F.col("hit.slope") * F.col("value") + F.col("hit.intercept")).otherwise(F.col("value"))
    unmatched = F.col("value").isNotNull() & F.col("segments").isNotNull() & F.col("hit").isNull() & F.col("reject_unmatched")
    reject = F.when(unmatched, "no calibration segment").when(F.isnan(out) | (F.abs(out) == float("inf")), "calibrated value not finite")
    return joined.select(*rows.columns, out.alias("calibrated"), reject.alias("reject"))


def normalize(rows: DataFrame, calibrations: DataFrame, metrics: DataFrame) -> DataFrame:
    """rows (device_id, metric_id, value, unit) with normalized_value and reject; metrics: canonical_unit, valid_min, valid_max."""
    named = calibrate(rows, calibrations).join(small(metrics.select("metric_id", "canonical_unit", "valid_min", "valid_max")), "metric_id", "left")
    named = converted(named, "calibrated", "unit", "canonical_unit")
    value = F.when(F.col("value").isNotNull() & F.col("reject").isNull(), F.col("converted"))
    named = named.withColumn("normalized_value", value)
    outside = F.when(F.col("normalized_value") < F.col("valid_min"), "below valid_min").when(F.col("normalized_value") > F.col("valid_max"), "above valid_max")
    named = named.withColumn("reject", F.when(F.col("value").isNotNull(), F.coalesce("reject", "convert_error", outside)))
    return named.select(*rows.columns, F.when(F.col("reject").isNull(), F.col("normalized_value")).alias("normalized_value"), "reject")
