"""The events table as samples, plain or with deterministic faults, in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SQL = "SELECT 'user-' || user_id AS device_id, event_type AS metric_id, epoch_us(ts) AS event_time_us, value, 0 AS quality, 0 AS flags, event_id AS sequence, event_id AS arrival FROM events"
DIRTY_SQL = "SELECT 'user-' || user_id AS device_id, event_type AS metric_id, epoch_us(ts) AS event_time_us, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value, CASE WHEN event_id % 13 = 0 THEN 2 ELSE 0 END AS quality, CASE WHEN event_id % 11 = 0 THEN 4 ELSE 0 END AS flags, event_id AS sequence, event_id AS arrival FROM events"


def events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/events.parquet")


def clean(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """device_id, metric_id, event_time_us, value, quality, flags, sequence, arrival; as a stream if asked for."""
    rows = events(spark, folder)
    if stream:
        rows = spark.readStream.schema(rows.schema).parquet(f"{folder}/events.parque[t]")  # a pattern: a single file is no folder to stream from
    time = F.unix_micros(F.col("ts").cast("timestamp"))
    return rows.select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("device_id"), F.col("event_type").alias("metric_id"), time.alias("event_time_us"), "value", F.lit(0).alias("quality"), F.lit(0).alias("flags"), F.col("event_id").alias("sequence"), F.col("event_id").alias("arrival"))


def dirty(spark: SparkSession, folder: str) -> DataFrame:
    """The same with nulls (each 17th event), device errors (13th) and synthetic rows (11th)."""
    rows = clean(spark, folder)
    return rows.withColumns({"value": F.when(F.col("arrival") % 17 != 0, F.col("value")), "quality": F.when(F.col("arrival") % 13 == 0, 2).otherwise(0), "flags": F.when(F.col("arrival") % 11 == 0, 4).otherwise(0)})
