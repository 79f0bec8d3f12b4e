"""Row checks in a fixed order, the first failure wins, and the gate on a file's error rate.

Input: device_id, metric, event_time (text), has_value, value, unit, quality, sequence, tags, and file, position.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.text import IDENTIFIER, TAG_KEY, UNIT, with_tag
from gaugeworks.functions.times import BUSINESS, FORMAT, parse_event_time
from gaugeworks.operators.dims import small

FUTURE_US = 10 * 60_000_000
MOST_TAGS = 16
ERROR = "struct<kind:string,code:string>"


def _failure(kind: str, code: str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(code).alias("code"))


def checks(ingest_us: int, history_us: int) -> list[tuple[Column, Column]]:
    """(fails, error) in order, on rows joined with the settings' tables."""
    time = F.col("time")
    tags = F.map_entries("tags")
    good_tag = F.forall(tags, lambda t: t["key"].rlike(TAG_KEY) & (F.octet_length(t["value"]) <= 128) & ~t["value"].rlike(r"[\x00-\x1F\x7F]"))
    infinite = F.lit(float("inf"))
    return [
        (~F.coalesce(F.col("device_id").rlike(IDENTIFIER), F.lit(False)), _failure(FORMAT, "bad_device_id")),
        (~F.coalesce(F.col("metric").rlike(IDENTIFIER), F.lit(False)), _failure(FORMAT, "bad_metric")),
        (~F.coalesce(F.col("unit").rlike(UNIT), F.lit(False)), _failure(FORMAT, "bad_unit_text")),
        (F.col("timezone").isNull(), _failure(BUSINESS, "unknown_device")),
        (F.col("canonical_unit").isNull(), _failure(BUSINESS, "unknown_metric")),
        (F.col("allowed").isNull(), _failure(BUSINESS, "metric_not_allowed")),
        (time["error"].isNotNull(), F.struct(time["kind"].alias("kind"), F.when(time["kind"] == FORMAT, "bad_time").otherwise("invalid_time").alias("code"))),
        (time["us"] > ingest_us + FUTURE_US, _failure(BUSINESS, "time_in_future")),
        (time["us"] < ingest_us - history_us, _failure(BUSINESS, "time_too_old")),
        (~F.coalesce("has_value", F.lit(False)), _failure(FORMAT, "missing_value")),
        (F.col("value").isNotNull() & (F.isnan("value") | (F.abs("value") == infinite)), _failure(BUSINESS, "value_not_finite")),
        (F.col("unit_ok").isNull(), _failure(BUSINESS, "unit_not_allowed")),
        (F.col("quality").isNotNull() & ~F.col("quality").between(0, 2), _failure(BUSINESS, "bad_quality")),
        (F.col("tags").isNotNull() & ((F.size("tags") > MOST_TAGS) | ~good_tag), _failure(BUSINESS, "bad_tags")),
    ]


def validate(records: DataFrame, dims: dict[str, DataFrame], ingest_us: int, history_us: int, earlier: bool = True) -> DataFrame:
    """records with event_time_us, error (null if accepted), quality (0 if absent) and the leap-second tag."""
    # two joins: a device with the metrics that it may send, a metric with its units
    allowed = dims["device_metrics"].groupBy("device_id").agg(F.collect_set("metric_id").alias("sends"))
    devices = dims["devices"].select("device_id", "timezone").join(small(allowed), "device_id", "left")
    units = dims["metric_units"].groupBy("metric_id").agg(F.collect_set("unit").alias("units"))
    metrics = dims["metrics"].select("metric_id", "canonical_unit").join(small(units), "metric_id", "left").withColumnRenamed("metric_id", "metric")
    rows = records.join(small(devices), "device_id", "left").join(small(metrics), "metric", "left")
    has = lambda found, what: F.when(F.array_contains(found, F.col(what)), True)
    rows = rows.withColumns({"allowed": has("sends", "metric"), "unit_ok": has("units", "unit")}).drop("sends", "units")
    rows = rows.withColumn("time", parse_event_time(F.col("event_time"), F.col("timezone"), earlier))
    error = functools.reduce(lambda so_far, check: so_far.when(*check), checks(ingest_us, history_us)[1:], F.when(*checks(ingest_us, history_us)[0]))
    rows = rows.withColumn("error", error.cast(ERROR))
    tags = F.when(F.col("time.leap"), with_tag(F.col("tags"), "leap_second", "true")).otherwise(F.col("tags"))
    kept = [c for c in records.columns if c not in ("tags", "quality", "event_time")]
    return rows.select(*kept, F.col("time.us").alias("event_time_us"), tags.alias("tags"), F.coalesce("quality", F.lit(0)).alias("quality"), "error")


def file_counts(validated: DataFrame, header: str | None = None) -> DataFrame:
    """file, total, accepted, format_errors, business_errors; with `header`, also fatal: whether an error's code begins with it."""
    kind = F.col("error.kind")
    fatal = [F.coalesce(F.max(F.col("error.code").startswith(header)), F.lit(False)).alias("fatal")] if header else []
    return validated.groupBy("file").agg(*fatal, F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("accepted"), F.count_if(kind == FORMAT).alias("format_errors"), F.count_if(kind == BUSINESS).alias("business_errors"))


def gate(counts: DataFrame, max_error_rate: float, min_records: int) -> DataFrame:
    """counts with error_rate and status: QUARANTINED if the rate of business errors is above the limit or the file is fatal, else VALIDATED."""
    rate = F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.col("business_errors") / F.greatest(F.col("total"), F.lit(min_records)))
    return counts.withColumn("error_rate", rate).withColumn("status", F.when((F.col("error_rate") > max_error_rate) | (F.col("fatal") if "fatal" in counts.columns else F.lit(False)), "QUARANTINED").otherwise("VALIDATED"))


def accepted(validated: DataFrame, gated: DataFrame) -> DataFrame:
    """The rows without an error of the files that passed the gate."""
    files = gated.filter("status = 'VALIDATED'").select("file")
    return validated.filter("error is null").join(small(files), "file", "left_semi")
