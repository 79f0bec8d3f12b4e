"""Per-device watermarks over rows in arrival order, and the order in which rows leave the reorder buffer."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators.dedup import emission_order

LATE, SYNTHETIC, FORCED = 2, 4, 8


def with_watermark(samples: DataFrame, lateness_us: int, seeds: DataFrame | None = None) -> DataFrame:
    """samples with watermark_us: the device's largest time so far, this row included, less the lateness.

    seeds: device_id and seed_us, the largest stored time of a device. The running maximum is a window over one
    device in arrival order; it streams through a sorted partition and keeps no frame."""
    w = Window.partitionBy("device_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = F.max("event_time_us").over(w)
    if seeds is None:
        return samples.withColumn("watermark_us", top - lateness_us)
    rows = samples.withColumn("__top", top).join(seeds, "device_id", "left")
    return rows.select(*samples.columns, (F.greatest("__top", "seed_us") - lateness_us).alias("watermark_us"))


def flag_late(samples: DataFrame, lateness_us: int, seeds: DataFrame | None = None) -> DataFrame:
    """samples with watermark_us and, in flags, LATE on rows before it."""
    rows = with_watermark(samples, lateness_us, seeds)
    return rows.withColumn("flags", F.when(F.col("event_time_us") < F.col("watermark_us"), F.col("flags").bitwiseOR(F.lit(LATE))).otherwise(F.col("flags")))


def emission_rank(samples: DataFrame) -> DataFrame:
    """samples with `emitted`, the place in a device's order."""
    return samples.withColumn("emitted", F.row_number().over(Window.partitionBy("device_id").orderBy(*emission_order())))


def stored_seeds(stored: DataFrame) -> DataFrame:
    return stored.groupBy("device_id").agg(F.max("event_time_us").alias("seed_us"))


def flag_forced(samples: DataFrame, lateness_us: int, most: int, seeds: DataFrame | None = None) -> DataFrame:
    """samples with watermark_us, LATE flags, and FORCED on rows that leave a device's full buffer before their time.

    A row waits until the watermark reaches its time; when `most` rows of a device wait after that, all of them leave. A
    device's rows stream through one task in arrival order, which holds at most `most` times."""
    rows = flag_late(samples, lateness_us, seeds)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        device, waiting, kept = None, [], None  # kept: rows of earlier frames that still wait, by place
        for frame in frames:
            frame = frame if kept is None else pd.concat([kept, frame], ignore_index=True)
            old = 0 if kept is None else len(kept)
            names, times, marks, late = frame["device_id"].tolist(), frame["event_time_us"].tolist(), frame["watermark_us"].tolist(), (frame["flags"] & LATE).astype(bool).tolist()
            forced = []
            waiting = [(times[i], i) for i in range(old)]
            heapq.heapify(waiting)
            for i in range(old, len(frame)):
                if names[i] != device:
                    device, waiting = names[i], []
                if late[i]:
                    continue
                heapq.heappush(waiting, (times[i], i))
                while waiting and waiting[0][0] <= marks[i]:
                    heapq.heappop(waiting)
                if len(waiting) >= most:
                    forced += [k for _, k in waiting]
                    waiting = []
            frame.loc[frame.index[forced], "flags"] |= FORCED
            left = sorted(k for _, k in waiting)
            kept = frame.iloc[left].reset_index(drop=True) if left else None
            yield frame.drop(index=frame.index[left])
        if kept is not None:
            yield kept

    return rows.repartition("device_id").sortWithinPartitions("device_id", "arrival").mapInPandas(run, rows.schema)
