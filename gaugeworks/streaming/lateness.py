"""Per-device watermarks on a stream: Spark's own watermark is one for the whole query, so the state is kept by device."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gaugeworks.operators.dedup import KEYS, key_columns
from gaugeworks.operators.lateness import LATE, SYNTHETIC


def flag_late_stream(samples: DataFrame, lateness_us: int) -> DataFrame:
    """The stream with watermark_us and LATE flags; inside a micro-batch rows count in arrival order."""
    schema = T.StructType([*samples.schema.fields, T.StructField("watermark_us", T.LongType())])

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("arrival", kind="stable")
        top = rows["event_time_us"].cummax()
        if state.exists:
            top = top.clip(lower=state.get[0])
        state.update((int(top.iloc[-1]),))
        rows["watermark_us"] = top - lateness_us
        rows["flags"] = rows["flags"].where(rows["event_time_us"] >= rows["watermark_us"], rows["flags"] | LATE).astype("int32")
        yield rows

    return samples.groupBy("device_id").applyInPandasWithState(run, schema, "top long", "append", GroupStateTimeout.NoTimeout)


def windows_stream(samples: DataFrame, size: str, lateness: str) -> DataFrame:
    """Counts and statistics of tumbling windows, emitted once the stream's watermark has passed their end.

    As in a batch, counts see every row and statistics the valid ones; exact percentiles need all rows of a window and are
    made when the window is stored."""
    rows = samples.withColumn("ts", F.timestamp_micros("event_time_us")).withWatermark("ts", lateness)
    valid = F.col("value").isNotNull() & (F.col("quality") != 2)
    v = F.when(valid, F.col("value"))
    first = F.min(F.when(valid, F.struct(F.struct("event_time_us", "arrival"), "value")))
    last = F.max(F.when(valid, F.struct(F.struct("event_time_us", (-F.col("arrival")).alias("arrival")), "value")))
    stats = {
        "sample_count": F.count("*"), "valid_count": F.count_if(valid), "synthetic_count": F.count_if(F.col("flags").bitwiseAND(F.lit(SYNTHETIC)) != 0), "bad_quality_count": F.count_if(F.col("quality") == 2),
        "min": F.min(v), "max": F.max(v), "avg": F.avg(v), "sum": F.sum(v), "stddev": F.stddev_pop(v), "first": first, "last": last,
    }
    found = rows.groupBy(F.window("ts", size), "device_id", "metric_id").agg(*(x.alias(n) for n, x in stats.items()))
    ends = [F.col(f"{n}.value").alias(f"{n}_value") for n in ("first", "last")]
    return found.select("device_id", "metric_id", F.unix_micros("window.start").alias("start_us"), F.unix_micros("window.end").alias("end_us"), *(n for n in stats if n not in ("first", "last")), *ends)


def dedup_stream(samples: DataFrame, lateness: str) -> DataFrame:
    """The first of the rows with one key (the sequence, or time and value of rows without one), remembered for the length
    of the watermark."""
    rows = samples.withColumns({**key_columns(), "ts": F.timestamp_micros("event_time_us")}).withWatermark("ts", lateness)
    return rows.dropDuplicatesWithinWatermark(KEYS).select(*samples.columns)
