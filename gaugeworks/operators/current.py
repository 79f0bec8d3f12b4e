"""The values a device's metrics have at a time, derived metrics, and expressions over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.config import DerivedMetric
from gaugeworks.functions import expression as E


def instants(samples: DataFrame, metrics: list[str]) -> DataFrame:
    """device_id, event_time_us and a column for each metric: its value at that very time (the last to arrive) or null."""
    rows = samples.filter(F.col("metric_id").isin(metrics) & F.col("value").isNotNull() & (F.col("quality") != 2))
    at = [F.max(F.when(F.col("metric_id") == m, F.struct("arrival", "value"))).getField("value").alias(m) for m in metrics]
    return rows.groupBy("device_id", "event_time_us").agg(*at)


def _by_device() -> Window:
    return Window.partitionBy("device_id").orderBy("event_time_us")


def current_values(samples: DataFrame, metrics: list[str]) -> DataFrame:
    """instants, with a metric's last known value where it has none. The running frame streams; a device is one task."""
    w = _by_device().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return instants(samples, metrics).select("device_id", "event_time_us", *(F.last(F.col(f"`{m}`"), ignorenulls=True).over(w).alias(m) for m in metrics))


def history(function: str, metric: str, duration_us: int) -> Column:
    """AVG, DELTA or RATE over the metric's own values (columns of instants) no older than the duration."""
    w = _by_device().rangeBetween(-duration_us, Window.currentRow)
    v = F.col(f"`{metric}`")
    if function == "avg":
        return F.avg(v).over(w)
    time = F.when(v.isNotNull(), F.col("event_time_us"))
    delta = F.when(F.count(v).over(w) >= 2, F.last(v, ignorenulls=True).over(w) - F.first(v, ignorenulls=True).over(w))
    if function == "delta":
        return delta
    passed = F.max(time).over(w) - F.min(time).over(w)
    return F.when(passed > 0, delta / (passed / 1e6))


def evaluate(samples: DataFrame, expressions: dict[str, str], lenient: bool = False) -> DataFrame:
    """device_id, event_time_us, and for each expression its value and `<name>_error`, at every instant of its metrics."""
    trees = {name: E.parse(text) for name, text in expressions.items()}
    metrics = list(dict.fromkeys(m for tree in trees.values() for m in _all_metrics(tree)))
    w = _by_device().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = instants(samples, metrics)
    compiler = E.Compiler(lambda m: F.last(F.col(f"`{m}`"), ignorenulls=True).over(w), history, lenient)
    out = {name: compiler.compile(tree) for name, tree in trees.items()}
    return rows.select("device_id", "event_time_us", *(c.alias(n) for name, x in out.items() for n, c in ((name, x.value), (f"{name}_error", x.error))))


def _all_metrics(tree: E.Node) -> list[str]:
    return E.metric_refs(tree)


def derived(samples: DataFrame, metric: DerivedMetric) -> DataFrame:
    """Samples of a derived metric: device_id, metric_id, event_time_us, value.

    null: inputs count at the instant only, and a missing one gives a null row. recent: an input's last value counts
    while it is no older than max_input_age (0: any age). skip: as null, without the null rows."""
    tree = E.parse(metric.expression)
    metrics = _all_metrics(tree)
    rows = instants(samples, metrics)
    if metric.missing_policy == "recent":
        w = _by_device().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        recent = []
        for m in metrics:
            last = F.last(F.when(F.col(f"`{m}`").isNotNull(), F.struct(F.col("event_time_us").alias("t"), F.col(f"`{m}`").alias("v"))), ignorenulls=True).over(w)
            fits = F.lit(True) if metric.max_input_age_us == 0 else F.col("event_time_us") - last["t"] <= metric.max_input_age_us
            recent.append(F.when(fits, last["v"]).alias(m))
        rows = rows.select("device_id", "event_time_us", *recent)
    found = E.Compiler(lambda m: F.col(f"`{m}`"), history).compile(tree)
    out = rows.select("device_id", F.lit(metric.id).alias("metric_id"), "event_time_us", found.value.alias("value"), found.error.alias("error"))
    out = out.filter("error is null").drop("error")
    return out.filter("value is not null") if metric.missing_policy == "skip" else out
