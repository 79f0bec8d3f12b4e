"""Exact nearest-rank quantiles of groups of any size, without a group's values in one task's memory.

Three steps, all with partial sums in the map tasks: a mergeable sketch of each group gives, for every fraction, two values between
which the rank must lie (the sketch's rank error is at most rows / ACCURACY); the rows below the first are counted, those
between are counted by value; a running count over these values finds the rank. So a task holds a sketch of at most a few
times ACCURACY numbers for each of its groups, and what is sorted by value is about 4 / ACCURACY of a group's rows and
one row for each distinct value. Should a rank fall outside of its bounds, the step is done again for its group over all values.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.sources.scratch import settled

ACCURACY = 10_000


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, fractions: dict[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """keys and a column for each fraction: the smallest value with at least fraction * n of the group's n values at or
    below it. Null values don't count; a group without any has nulls. NaN is the largest value."""
    rows = rows.select(*keys, F.col(value).cast("double").alias("v"))
    names, slack = list(fractions), 2.0 / accuracy
    cuts = [min(max(f + d, 0.0), 1.0) for f in fractions.values() for d in (-slack, slack)]
    sketch = rows.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.percentile_approx("v", cuts, accuracy).alias("cuts"))
    # the ends of the scale have no error on their outer side
    low = [F.when(F.lit(cuts[2 * j] <= 0), F.col("least")).otherwise(F.col("cuts")[2 * j]) for j in range(len(names))]
    high = [F.when(F.lit(cuts[2 * j + 1] >= 1), F.col("most")).otherwise(F.col("cuts")[2 * j + 1]) for j in range(len(names))]
    rank = [F.greatest(F.ceil(F.col("n") * F.lit(f)), F.lit(1)) for f in fractions.values()]
    bounds = settled(sketch.select(*keys, "n", F.array(*(F.struct(F.lit(j).alias("j"), rank[j].alias("rank"), low[j].alias("low"), high[j].alias("high")) for j in range(len(names)))).alias("wanted")))
    found = settled(_select(rows, bounds, keys))
    missed = bounds.join(found.filter("v is null").select(*keys).distinct(), keys, "left_semi").filter("n > 0")
    if not missed.isEmpty():
        open_ended = missed.withColumn("wanted", F.transform("wanted", lambda w: F.struct(w["j"].alias("j"), w["rank"].alias("rank"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))))
        found = found.join(missed.select(*keys), keys, "left_anti").unionByName(_select(rows, open_ended, keys))
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("j") == j, F.col("v"))).alias(name) for j, name in enumerate(names)))


def _select(rows: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """keys, j, v: the value of each wanted rank; null where it isn't between its bounds. Null bounds are open."""
    nothing = functools.reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in keys))
    placed = rows.filter("v is not null").join(bounds.select(*(F.col(k).alias(f"b_{k}") for k in keys), "wanted"), nothing).drop(*(f"b_{k}" for k in keys))
    side = lambda w: F.when(F.col("v") < w["low"], -1).when(F.col("v") > w["high"], 1).otherwise(0)
    near = placed.select(*keys, "v", F.explode(F.filter(F.transform("wanted", lambda w: F.struct(w["j"].alias("j"), w["rank"].alias("rank"), side(w).alias("side"))), lambda w: w["side"] <= 0)).alias("w"))
    counted = near.groupBy(*keys, "w.j", "w.rank", F.when(F.col("w.side") == 0, F.col("v")).alias("v")).agg(F.count("*").alias("n"))
    # the row of those below has a null value and comes first
    order = Window.partitionBy(*keys, "j").orderBy(F.col("v").asc_nulls_first())
    reached = counted.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    best = reached.groupBy(*keys, "j").agg(F.min(F.when((F.col("upto") >= F.col("rank")) & F.col("v").isNotNull() & (F.col("upto") - F.col("n") < F.col("rank")), F.col("v"))).alias("v"))
    wanted = bounds.select(*keys, F.explode("wanted").alias("w")).select(*keys, "w.j")
    same = functools.reduce(lambda a, b: a & b, (F.col(f"b_{k}").eqNullSafe(F.col(k)) for k in [*keys, "j"]))
    renamed = best.select(*(F.col(k).alias(f"b_{k}") for k in [*keys, "j"]), "v")
    return wanted.join(renamed, same, "left").select(*keys, "j", "v")
