"""Tumbling windows, their versions, and corrections by late rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators.dims import small
from gaugeworks.operators.lateness import SYNTHETIC

KEY = ["device_id", "metric_id", "window_type", "start_us"]


def _valid() -> Column:
    return F.col("value").isNotNull() & (F.col("quality") != 2)


def assign(samples: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """samples with size_us and start_us, one row for each size. Times before 1970 truncate towards zero."""
    rows = samples.withColumn("size_us", F.explode(F.array(*(F.lit(s * 1_000_000).cast("bigint") for s in sizes)))) if len(sizes) > 1 else samples.withColumn("size_us", F.lit(sizes[0] * 1_000_000).cast("bigint"))
    return rows.withColumn("start_us", F.expr("event_time_us div size_us * size_us"))


def aggregate(samples: DataFrame, sizes: tuple[int, ...], metrics: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """One row for each series, size and window that holds a row. One shuffle, by the window. only: the windows wanted
    (device_id, metric_id, size_us, start_us), each once; without it all.

    Counts see every row; statistics see the valid ones. Percentiles are exact nearest ranks. metrics: metric_id and
    expected_period_us, for missing_count."""
    value = F.when(_valid(), F.col("value"))
    place = F.struct("event_time_us", "arrival")
    rank = lambda f: F.expr(f"percentile_disc({f}) WITHIN GROUP (ORDER BY CASE WHEN value IS NOT NULL AND quality <> 2 THEN value END)")
    assigned = assign(samples, sizes)
    if only is not None:
        assigned = assigned.join(only, ["device_id", "metric_id", "size_us", "start_us"], "left_semi")
    found = assigned.groupBy("device_id", "metric_id", "size_us", "start_us").agg(
        F.count("*").alias("sample_count"),
        F.count_if(F.col("flags").bitwiseAND(F.lit(SYNTHETIC)) != 0).alias("synthetic_count"),
        F.count_if(F.col("quality") == 2).alias("bad_quality_count"),
        F.count_if(_valid()).alias("valid_count"),
        F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("avg"), F.sum(value).alias("sum"),
        F.stddev_pop(value).alias("stddev"),
        F.min(F.when(_valid(), F.struct(place, "value"))).alias("first"), F.max(F.when(_valid(), F.struct(F.struct("event_time_us", (-F.col("arrival")).alias("arrival")), "value"))).alias("last"),
        rank(0.5).alias("p50"), rank(0.95).alias("p95"), rank(0.99).alias("p99"),
    )
    missing = F.lit(0).cast("bigint")
    if metrics is not None:
        found = found.join(small(metrics.select("metric_id", "expected_period_us")), "metric_id", "left")
        missing = F.when(F.col("expected_period_us") > 0, F.greatest(F.lit(0), F.expr("size_us div expected_period_us") - F.col("sample_count"))).otherwise(F.lit(0)).cast("bigint")
    return found.select(
        "device_id", "metric_id", F.concat((F.expr("size_us div 1000000")).cast("string"), F.lit("s")).alias("window_type"), "start_us", (F.col("start_us") + F.col("size_us")).alias("end_us"),
        "sample_count", "valid_count", "synthetic_count", "bad_quality_count", missing.alias("missing_count"), "min", "max", "avg", "sum", "stddev",
        F.col("first.value").alias("first_value"), F.col("first.col1.event_time_us").alias("first_us"), F.col("last.value").alias("last_value"), F.col("last.col1.event_time_us").alias("last_us"), "p50", "p95", "p99",
    )


def closed(aggregates: DataFrame, watermarks: DataFrame) -> DataFrame:
    """The windows that end at or before their device's watermark. watermarks: device_id, watermark_us."""
    return aggregates.join(watermarks, "device_id").filter("end_us <= watermark_us").select(*aggregates.columns)


def correct(versions: DataFrame, samples: DataFrame, late: DataFrame, sizes: tuple[int, ...], metrics: DataFrame | None = None) -> DataFrame:
    """versions (aggregates with version and superseded) after the late rows: touched windows get one more version.

    samples: all rows, the late ones among them; only those in touched windows are read again."""
    touched = keys_of(late, sizes)
    tops = versions.groupBy(*KEY).agg((F.max("version") + 1).alias("version")).join(touched, KEY, "left_semi")
    fresh = recomputed(samples, tops.select(*KEY), sizes, metrics).join(tops, KEY).withColumn("superseded", F.lit(False))
    gone = F.col("superseded") | F.coalesce("__touched", F.lit(False))
    old = versions.join(touched.withColumn("__touched", F.lit(True)), KEY, "left").withColumn("superseded", gone)
    return old.select(*versions.columns).unionByName(fresh.select(*versions.columns))


def current(versions: DataFrame) -> DataFrame:
    """The highest version of each window."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("version"))
    return versions.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def upsert(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """fresh windows replace version 1 where it isn't superseded, else they become the next version."""
    return apply(stored, changes(stored, fresh))


def changes(stored: DataFrame, fresh: DataFrame, late: DataFrame | None = None) -> DataFrame:
    """The rows that differ after an import: fresh windows with their versions, and stored ones that they supersede.

    stored: all versions; fresh: the touched windows over all samples. late: KEY of windows that the import's late rows
    touch. Of the windows in it that are stored, all versions are superseded and the fresh one is the next; the others
    replace version 1 where it isn't superseded, else they are the next version; a new window is version 1."""
    top = stored.groupBy(*KEY).agg(F.max("version").alias("top"), F.max(F.when(F.col("version") == 1, F.col("superseded"))).alias("gone"))
    placed = fresh.join(top, KEY, "left")
    if late is None:
        placed = placed.withColumn("corrects", F.lit(False))
    else:
        placed = placed.join(late.select(*KEY).distinct().withColumn("corrects", F.lit(True)), KEY, "left").withColumn("corrects", F.coalesce("corrects", F.lit(False)) & F.col("top").isNotNull())
    version = F.when(F.col("top").isNull() | (~F.col("corrects") & ~F.coalesce("gone", F.lit(True))), F.lit(1)).otherwise(F.col("top") + 1)
    placed = placed.withColumns({"version": version, "superseded": F.lit(False)})
    old = stored.join(placed.filter("corrects").select(*KEY), KEY, "left_semi").filter("not superseded").withColumn("superseded", F.lit(True))
    return placed.select(*stored.columns).unionByName(old)


def apply(stored: DataFrame, changed: DataFrame) -> DataFrame:
    """stored with the changed rows in place of those of the same window and version."""
    return stored.join(changed.select(*KEY, "version"), [*KEY, "version"], "left_anti").unionByName(changed.select(*stored.columns))


def keys_of(samples: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """KEY of the windows that rows fall into."""
    return assign(samples, sizes).select("device_id", "metric_id", F.concat(F.expr("size_us div 1000000").cast("string"), F.lit("s")).alias("window_type"), "start_us").distinct()


def recomputed(samples: DataFrame, hit: DataFrame, sizes: tuple[int, ...], metrics: DataFrame | None = None) -> DataFrame:
    """The windows in `hit` (KEY) over all samples."""
    sized = hit.withColumn("size_us", F.regexp_replace("window_type", "s$", "").cast("bigint") * 1_000_000)
    return aggregate(samples, sizes, metrics, sized.select("device_id", "metric_id", "size_us", "start_us"))


def sliding(samples: DataFrame, size_us: int, step_us: int) -> DataFrame:
    """Windows of size_us that begin every step_us: device_id, metric_id, start_us, end_us, sample_count, valid_count, min,
    max, sum, avg. size_us is a multiple of step_us. Rows are summed up by step first, and only the sums are repeated."""
    if size_us % step_us:
        raise ValueError("the size must be a multiple of the step")
    value = F.when(_valid(), F.col("value"))
    panes = samples.withColumn("pane", F.col("event_time_us") - F.pmod("event_time_us", F.lit(step_us)))
    panes = panes.groupBy("device_id", "metric_id", "pane").agg(F.count("*").alias("sample_count"), F.count(value).alias("valid_count"), F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value).alias("sum"))
    spread = panes.withColumn("start_us", F.explode(F.transform(F.sequence(F.lit(0), F.lit(size_us // step_us - 1)), lambda k: (F.col("pane") - k * step_us).cast("bigint"))))
    found = spread.groupBy("device_id", "metric_id", "start_us").agg(*(F.sum(c).alias(c) for c in ("sample_count", "valid_count")), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("sum").alias("sum"))
    return found.select("device_id", "metric_id", "start_us", (F.col("start_us") + size_us).alias("end_us"), "sample_count", "valid_count", "min", "max", "sum", (F.col("sum") / F.nullif(F.col("valid_count"), F.lit(0))).alias("avg"))


def sessions(samples: DataFrame, gap_us: int) -> DataFrame:
    """Runs of a series' rows with at most gap_us between neighbours: device_id, metric_id, start_us, end_us (first and last
    time), sample_count, valid_count, min, max, avg. One shuffle, by series."""
    w = Window.partitionBy("device_id", "metric_id").orderBy("event_time_us")
    opens = F.coalesce(F.col("event_time_us") - F.lag("event_time_us").over(w) > gap_us, F.lit(True))
    rows = samples.withColumn("__opens", opens).withColumn("__session", F.sum(F.col("__opens").cast("int")).over(w))
    value = F.when(_valid(), F.col("value"))
    found = rows.groupBy("device_id", "metric_id", "__session").agg(F.min("event_time_us").alias("start_us"), F.max("event_time_us").alias("end_us"), F.count("*").alias("sample_count"), F.count(value).alias("valid_count"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("avg"))
    return found.drop("__session")
