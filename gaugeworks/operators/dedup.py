"""Two-key deduplication: by sequence where there is one, else by time and value; the first emitted row stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def emission_order() -> list[Column]:
    """Time, sequenced rows first, sequence, arrival."""
    return [F.col("event_time_us"), F.col("sequence").isNull(), F.col("sequence"), F.col("arrival")]


def key_columns(value: str = "value") -> dict[str, Column]:
    """Columns that are equal exactly for duplicates: null values equal each other, as do 0 and -0."""
    bare = F.col("sequence").isNull()
    return {
        "key_sequence": F.col("sequence"),
        "key_time": F.when(bare, F.col("event_time_us")),
        "key_value": F.when(bare, F.col(value) + F.lit(0.0)),
    }


KEYS = ["device_id", "metric_id", "key_sequence", "key_time", "key_value"]


def dedup(samples: DataFrame, value: str = "value") -> DataFrame:
    """One row for each key, the first in emission order. The window's partitions are the duplicates of one key."""
    keyed = samples.withColumns(key_columns(value))
    first = F.row_number().over(Window.partitionBy(*KEYS).orderBy(*emission_order()))
    return keyed.withColumn("__n", first).filter("__n = 1").select(*samples.columns)


def not_stored(samples: DataFrame, stored: DataFrame, value: str = "value") -> DataFrame:
    """The samples whose key the stored ones don't have (nulls of keys are equal)."""
    new, old = samples.withColumns(key_columns(value)), stored.withColumns(key_columns(value)).select(*KEYS).distinct()
    old = old.select(*(F.col(k).alias(f"old_{k}") for k in KEYS))
    on = F.lit(True)
    for k in KEYS:
        on &= F.col(k).eqNullSafe(F.col(f"old_{k}"))
    return new.join(old, on, "left_anti").select(*samples.columns)
