"""Rolling statistics of a series by count, by time, or both. Valid rows only; ties in time by arrival.

Frames by both limits begin at the later of two rows. Their cost doesn't depend on the limits: the first row young enough comes from a
running count over rows and frames' beginnings in one order of time, sums are differences of running sums, and extremes come from two
overlapping stretches of 2**k rows, whose extremes are made by doubling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.sources.scratch import settled

SERIES = ("device_id", "metric_id")
TIES = 1 << 31


def rolling(samples: DataFrame, count: int | None = None, duration_us: int | None = None, min_count: int = 1) -> DataFrame:
    """The valid rows of samples (a value, no device error) with n, mean, low, high, stddev, rate, oldest, newest, ready.

    count: the newest N rows. duration_us: rows at most that old. With both, a row must pass either test: frames by
    time take the rows of a count frame that are young enough. Rows at one time see those that came before them."""
    rows = samples.filter("value is not null and quality <> 2")
    v, order = F.col("value"), Window.partitionBy(*SERIES).orderBy("event_time_us", "arrival")
    if duration_us is not None and count is not None:
        rows = _by_both(rows, count, duration_us)
    elif duration_us is not None:
        # one number in place of (time, place among the rows of that time), so that a native range frame ends at the row
        # itself: times lie 2 * TIES apart, and a frame of d * 2 * TIES + TIES - 1 holds all rows of time t - d and none before
        tie = F.row_number().over(Window.partitionBy(*SERIES, "event_time_us").orderBy("arrival")) - 1
        wide = "decimal(38,0)"
        rows = rows.withColumn("__at", (F.col("event_time_us").cast("decimal(20,0)") * F.lit(2 * TIES).cast("decimal(11,0)") + tie).cast(wide))
        frame = f"OVER (PARTITION BY {', '.join(SERIES)} ORDER BY __at RANGE BETWEEN CAST({duration_us * 2 * TIES + TIES - 1} AS {wide}) PRECEDING AND CURRENT ROW)"
        found = {"n": "count(*)", "mean": "avg(value)", "low": "min(value)", "high": "max(value)", "stddev": "stddev_pop(value)", "oldest": "first(value)", "__t": "first(event_time_us)"}
        rows = rows.withColumns({name: F.expr(f"{f} {frame}") for name, f in found.items()})
    else:
        w = order.rowsBetween(-(count - 1), Window.currentRow)
        rows = rows.withColumns({"n": F.count("*").over(w), "mean": F.avg(v).over(w), "low": F.min(v).over(w), "high": F.max(v).over(w), "stddev": F.stddev_pop(v).over(w), "oldest": F.first(v).over(w), "__t": F.first("event_time_us").over(w)})
    passed = F.col("event_time_us") - F.col("__t")
    rate = F.when((F.col("n") < 2) | (passed <= 0), F.lit(0.0)).otherwise((v - F.col("oldest")) / (F.greatest(passed, F.lit(1)) / 1e6))
    stddev = F.when(F.col("n") < 2, F.lit(0.0)).otherwise(F.col("stddev"))
    return rows.select(*samples.columns, "n", "mean", "low", "high", stddev.alias("stddev"), rate.alias("rate"), "oldest", v.alias("newest"), (F.col("n") >= min_count).alias("ready"))


def _by_both(rows: DataFrame, count: int, duration_us: int) -> DataFrame:
    """rows with n, mean, low, high, stddev, oldest and __t (the oldest row's time) of frames by both limits."""
    series = Window.partitionBy(*SERIES)
    order = series.orderBy("event_time_us", "arrival")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # sums are of differences from the series' first value, which keeps them small
    base = rows.withColumn("__place", F.row_number().over(order)).withColumn("__off", F.col("value") - F.first("value").over(order))
    base = base.withColumns({"__sum": F.coalesce(F.sum("__off").over(before), F.lit(0.0)), "__squares": F.coalesce(F.sum(F.col("__off") * F.col("__off")).over(before), F.lit(0.0)), "__low0": F.col("value"), "__high0": F.col("value")})
    levels = range(1, count.bit_length())
    for k in levels:  # of the 2**k rows that end here
        base = base.withColumns({f"__low{k}": F.least(f"__low{k - 1}", F.lag(f"__low{k - 1}", 1 << (k - 1)).over(order)), f"__high{k}": F.greatest(f"__high{k - 1}", F.lag(f"__high{k - 1}", 1 << (k - 1)).over(order))})
    every = [0, *levels]
    base = base.withColumns({"__lows": F.array(*(f"__low{k}" for k in every)), "__highs": F.array(*(f"__high{k}" for k in every))})
    base = settled(base.drop(*(f"__{x}{k}" for x in ("low", "high") for k in every)))
    ends = base.select(*SERIES, F.col("event_time_us").alias("at"), F.lit(1).alias("row"), F.lit(None).cast("int").alias("__place"))
    begins = base.select(*SERIES, (F.col("event_time_us") - duration_us).alias("at"), F.lit(0).alias("row"), "__place")
    older = ends.unionByName(begins).withColumn("__older", F.sum("row").over(series.orderBy("at", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter("row = 0").select(*SERIES, "__place", "__older")
    found = _same(base, older, "__place", "__place", ["__older"])
    first = F.greatest(F.col("__place") - (count - 1), F.col("__older") + 1)
    found = found.withColumn("__first", first).withColumn("n", (F.col("__place") - F.col("__first") + 1).cast("bigint"))
    found = found.withColumn("__level", F.floor(F.log2("n") + 1e-9).cast("int")).withColumn("__other", F.col("__first") + F.pow(F.lit(2.0), F.col("__level")).cast("bigint") - 1)
    found = _same(found, base.select(*SERIES, "__place", F.col("__sum").alias("__sum1"), F.col("__squares").alias("__squares1"), F.col("value").alias("oldest"), F.col("event_time_us").alias("__t")), "__first", "__place", ["__sum1", "__squares1", "oldest", "__t"])
    found = _same(found, base.select(*SERIES, "__place", F.col("__lows").alias("__lows1"), F.col("__highs").alias("__highs1")), "__other", "__place", ["__lows1", "__highs1"])
    total, squares = F.col("__sum") + F.col("__off") - F.col("__sum1"), F.col("__squares") + F.col("__off") * F.col("__off") - F.col("__squares1")
    shift = F.col("value") - F.col("__off")
    at = lambda name: F.get(name, F.col("__level"))
    spread = F.greatest(squares / F.col("n") - (total / F.col("n")) * (total / F.col("n")), F.lit(0.0))
    return found.select(*rows.columns, "n", (shift + total / F.col("n")).alias("mean"), F.least(at("__lows"), at("__lows1")).alias("low"), F.greatest(at("__highs"), at("__highs1")).alias("high"), F.sqrt(spread).alias("stddev"), "oldest", "__t")


def _same(left: DataFrame, right: DataFrame, here: str, there: str, columns: list[str]) -> DataFrame:
    """left with columns of the row of its series whose `there` is its `here`."""
    renamed = right.select(*(F.col(c).alias(f"__r_{c}") for c in (*SERIES, there)), *columns)
    on = F.col(here) == F.col(f"__r_{there}")
    for c in SERIES:
        on &= F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    return left.join(renamed, on, "left").drop(*(f"__r_{c}" for c in (*SERIES, there)))
