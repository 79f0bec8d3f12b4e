"""Linear unit conversion, in the order base = v * scale + offset; out = (base - offset2) / scale2."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unit, dimension, scale and offset to the dimension's base.
UNITS = (
    ("C", "temperature", 1.0, 273.15),
    ("F", "temperature", 5.0 / 9.0, 255.3722222222222222),
    ("K", "temperature", 1.0, 0.0),
    ("Pa", "pressure", 1.0, 0.0),
    ("kPa", "pressure", 1e3, 0.0),
    ("MPa", "pressure", 1e6, 0.0),
    ("bar", "pressure", 1e5, 0.0),
    ("mm/s", "velocity", 1e-3, 0.0),
    ("cm/s", "velocity", 1e-2, 0.0),
    ("m/s", "velocity", 1.0, 0.0),
    ("W", "power", 1.0, 0.0),
    ("kW", "power", 1e3, 0.0),
    ("MW", "power", 1e6, 0.0),
    ("L/min", "flow", 1.0 / 60.0, 0.0),
    ("m3/h", "flow", 1000.0 / 3600.0, 0.0),
    ("m3/s", "flow", 1000.0, 0.0),
)


def dimension(unit: str) -> str | None:
    return next((d for u, d, _, _ in UNITS if u == unit), None)


def _of(unit: Column, field: int) -> Column:
    """A unit's dimension, scale or offset, from a constant map; null for another unit."""
    return F.try_element_at(F.create_map(*(F.lit(x) for row in UNITS for x in (row[0], row[field]))), unit)


def convert(value: Column, source: Column, target: Column) -> tuple[Column, Column]:
    """The converted value and an error, one of them null. A base below zero is an error: no negative flow, pressure,
    velocity or power, and no temperature under 0 K."""
    infinite = F.lit(float("inf"))
    base = value * _of(source, 2) + _of(source, 3)
    out = (base - _of(target, 3)) / _of(target, 2)
    bad = lambda x: F.isnan(x) | (F.abs(x) == infinite)
    kinds = _of(source, 1), _of(target, 1)
    error = (
        F.when(kinds[0].isNull() | kinds[1].isNull(), "unknown unit")
        .when(kinds[0] != kinds[1], "different dimensions")
        .when(bad(base) | bad(out), "not finite")
        .when(base < 0, "below physical zero")
    )
    return F.when(error.isNull(), out), error


def converted(rows: DataFrame, value: str, source: str, target: str) -> DataFrame:
    """rows with `converted` and `convert_error`, as convert gives them; each step is computed once for a row."""
    infinite = F.lit(float("inf"))
    step = rows.select("*", *(_of(F.col(unit), i).alias(f"__{side}_{name}") for side, unit in (("s", source), ("t", target)) for i, name in ((1, "kind"), (2, "scale"), (3, "offset"))))
    step = step.withColumn("__base", F.col(value) * F.col("__s_scale") + F.col("__s_offset"))
    step = step.withColumn("__out", (F.col("__base") - F.col("__t_offset")) / F.col("__t_scale"))
    bad = lambda x: F.isnan(x) | (F.abs(x) == infinite)
    error = (
        F.when(F.col("__s_kind").isNull() | F.col("__t_kind").isNull(), "unknown unit")
        .when(F.col("__s_kind") != F.col("__t_kind"), "different dimensions")
        .when(bad("__base") | bad("__out"), "not finite")
        .when(F.col("__base") < 0, "below physical zero")
    )
    step = step.withColumn("convert_error", error)
    return step.select(*rows.columns, F.when(F.col("convert_error").isNull(), F.col("__out")).alias("converted"), "convert_error")


def convert_expr(value: str, source: str, target: str) -> str:
    """The same arithmetic as SQL text for two known units, for oracles."""
    a, b = (next(u for u in UNITS if u[0] == x) for x in (source, target))
    return f"((({value}) * CAST({a[2]!r} AS DOUBLE) + CAST({a[3]!r} AS DOUBLE)) - CAST({b[3]!r} AS DOUBLE)) / CAST({b[2]!r} AS DOUBLE)"
