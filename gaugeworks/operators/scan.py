"""Running values of devices of any size: one device's rows are spread over all tasks.

A window over a device is one task, however many rows the device has. Here rows are dealt by ranges of (device, order), so that a part is
a stretch of a device; what a running value has reached at the end of each part is carried into the parts behind it. Inside a part the
value runs as usual. Only devices that lie in more than one part have carries: at most two for each part, so they are
broadcast. Parts are written to the shared folder, as both uses must see the same ones.

For most data, with many devices and none too large, lateness.flag_late and current.current_values need one shuffle less.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators.current import instants
from gaugeworks.operators.lateness import LATE
from gaugeworks.sources.scratch import settled


def parts(rows: DataFrame, order: str) -> DataFrame:
    """rows with `part`, which rises with (device_id, order); rows equal in both are in one part."""
    return settled(rows.repartitionByRange(F.col("device_id"), F.col(order)).withColumn("part", F.spark_partition_id()))


def carried(parted: DataFrame, ends: dict[str, Column], over: dict[str, Column]) -> DataFrame:
    """parted with a column `before_<name>` for each name: what the device's earlier parts have reached, null in its first.

    ends: the aggregate of one part; over: how the parts' ends (columns of the same names) run on, in order of part."""
    each = parted.groupBy("device_id", "part").agg(*(e.alias(n) for n, e in ends.items()))
    earlier = Window.partitionBy("device_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(Window.partitionBy("device_id").orderBy("part"))
    known = each.select(F.col("device_id").alias("__device"), F.col("part").alias("__part"), *(o.over(earlier).alias(f"before_{n}") for n, o in over.items()), first.alias("__first")).filter("__first > 1").drop("__first")
    same = F.col("device_id").eqNullSafe(F.col("__device")) & (F.col("part") == F.col("__part"))
    return parted.join(F.broadcast(known), same, "left").drop("__device", "__part")


def flag_late_spread(samples: DataFrame, lateness_us: int, seeds: DataFrame | None = None) -> DataFrame:
    """lateness.flag_late for devices of any size: samples with watermark_us and LATE flags."""
    rows = carried(parts(samples, "arrival"), {"top": F.max("event_time_us")}, {"top": F.max("top")})
    w = Window.partitionBy("device_id", "part").orderBy("arrival").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("top", F.greatest("before_top", F.max("event_time_us").over(w)))
    if seeds is not None:
        rows = rows.join(seeds, "device_id", "left").withColumn("top", F.greatest("top", "seed_us"))
    late = F.when(F.col("event_time_us") < F.col("top") - lateness_us, F.col("flags").bitwiseOR(F.lit(LATE))).otherwise(F.col("flags"))
    return rows.select(*(c if c != "flags" else late.alias("flags") for c in samples.columns), (F.col("top") - lateness_us).alias("watermark_us"))


def current_values_spread(samples: DataFrame, metrics: list[str]) -> DataFrame:
    """current.current_values for devices of any size: each instant with every metric's last known value."""
    names = {f"m{i}": m for i, m in enumerate(metrics)}
    rows = instants(samples, metrics).select("device_id", "event_time_us", *(F.col(f"`{m}`").alias(n) for n, m in names.items()))
    newest = {n: F.max_by(n, F.when(F.col(n).isNotNull(), F.col("event_time_us"))) for n in names}
    rows = carried(parts(rows, "event_time_us"), newest, {n: F.last(n, ignorenulls=True) for n in names})
    w = Window.partitionBy("device_id", "part").orderBy("event_time_us").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("device_id", "event_time_us", *(F.coalesce(F.last(n, ignorenulls=True).over(w), F.col(f"before_{n}")).alias(m) for n, m in names.items()))
