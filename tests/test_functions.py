"""Known answers of the scalar functions and the expression language."""

import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import expression as E
from gaugeworks.functions import text, times, units
from gaugeworks.functions.durations import parse_duration


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("source,target,given,out", [("C", "K", 0.0, 273.15), ("bar", "kPa", 1.0, 100.0), ("L/min", "m3/h", 60.0, 3.6), ("F", "C", 32.0, 0.0)])
def test_units(spark, source, target, given, out):
    found, error = units.convert(F.lit(given), F.lit(source), F.lit(target))
    assert value(spark, found) == pytest.approx(out, abs=1e-9) and value(spark, error) is None


@pytest.mark.parametrize("source,target,given", [("C", "kPa", 1.0), ("xx", "K", 1.0), ("kPa", "Pa", -1.0), ("C", "K", -300.0), ("MPa", "Pa", 1e308)])
def test_unit_errors(spark, source, target, given):
    found, error = units.convert(F.lit(given), F.lit(source), F.lit(target))
    assert value(spark, found) is None and value(spark, error)


@pytest.mark.parametrize(
    "raw,zone,us,kind",
    [
        ("1700000000123", None, 1700000000123000, None),
        ("-42", None, -42000, None),
        ("9223372036854776", None, None, "business"),  # one past the largest time in microseconds
        ("31415926535897932", None, None, "business"),
        ("2025-05-17T04:05:06.75Z", None, 1747454706750000, None),
        ("2025-05-17T09:35:06.75+05:30", None, 1747454706750000, None),
        ("2025-05-16T20:05:06-0800", None, 1747454706000000, None),
        ("2025-05-16T20:05:06-99:00", None, None, "business"),
        ("2025-05-16T20:05:06", None, None, "format"),
        ("2025-05-16 20:05:06Z", None, None, "format"),
        ("2025-04-31T00:00:00Z", None, None, "format"),
        ("2027-03-28T02:15:00", "Europe/Berlin", None, "business"),  # clocks go from 2 to 3
        ("2027-10-31T02:15:00", "Europe/Berlin", 1824941700000000, None),  # shown twice
        ("2016-12-31T23:59:60.25Z", None, 1483228800250000, None),
        ("", None, None, "format"),
        ("noon", "UTC", None, "format"),
    ],
)
def test_times(spark, raw, zone, us, kind):
    found = value(spark, times.parse_event_time(F.lit(raw), F.lit(zone) if zone else None))
    assert (found["us"], found["kind"]) == (us, kind), found


def test_later_of_two(spark):
    found = value(spark, times.parse_event_time(F.lit("2027-10-31T02:15:00"), F.lit("Europe/Berlin"), earlier=False))
    assert found["us"] == 1824941700000000 + 3600_000_000
    half = value(spark, times.parse_event_time(F.lit("2028-04-02T01:40:00"), F.lit("Australia/Lord_Howe"), earlier=False))
    assert half["us"] - value(spark, times.parse_event_time(F.lit("2028-04-02T01:40:00"), F.lit("Australia/Lord_Howe")))["us"] == 1800_000_000


def test_durations():
    assert [parse_duration(x) for x in ("500ms", "10s", "5m", "2h", "7d")] == [500_000, 10_000_000, 300_000_000, 7_200_000_000, 604_800_000_000]
    assert parse_duration(3, bare_seconds=True) == 3_000_000
    for bad in ("5", "x", "5 weeks", "99999999999999d"):
        with pytest.raises(ValueError):
            parse_duration(bad)


def test_text(spark):
    assert value(spark, text.tags_json(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2")))) == '{"a":"2","b":"1"}'
    assert value(spark, text.tags_from_pairs(F.lit("k=v|x=y=z|k=w"))) == {"k": "w", "x": "y=z"}
    assert value(spark, text.tags_from_pairs(F.lit("kv"))) is None and value(spark, text.tags_from_pairs(F.lit(""))) == {}
    assert value(spark, text.sanitize(F.lit("a\x00b\nc" + "x" * 300))) == "abc" + "x" * 253
    assert value(spark, text.value_text(F.lit(-0.0))) == value(spark, text.value_text(F.lit(0.0)))


def run(spark, source, **metrics):
    found = E.compile_expression(source, lambda m: F.lit(metrics.get(m)))
    row = spark.range(1).select(found.value.alias("v"), found.error.alias("e")).first()
    return row["e"] if row["e"] else row["v"]


class Fault(Exception):
    pass


def plainly(tree, metrics):
    """A tree of tuples by plain Python rules: None for no data, Fault for an error."""
    if not isinstance(tree, tuple):
        return metrics.get(tree) if isinstance(tree, str) else tree
    op, *args = tree
    if op == "IF":
        chosen = plainly(args[0], metrics)
        return None if chosen is None else plainly(args[1 if chosen else 2], metrics)
    a = plainly(args[0], metrics)
    if op in ("and", "or"):
        if a is (op == "or"):
            return a
        b = plainly(args[1], metrics)
        return b if b is (op == "or") or a is not None else None if b is None else (None if a is None else b)
    rest = [plainly(x, metrics) for x in args[1:]]
    if a is None or None in rest:
        return None
    if op == "not":
        return not a
    if op in "+-*<>":
        return {"+": lambda b: a + b, "-": lambda b: a - b, "*": lambda b: a * b, "<": lambda b: a < b, ">": lambda b: a > b}[op](rest[0])
    if op == "/":
        if rest[0] == 0:
            raise Fault
        return a / rest[0]
    if op == "CLAMP":
        if rest[0] > rest[1]:
            raise Fault
        return min(max(a, rest[0]), rest[1])
    return {"ABS": abs, "MIN": lambda *x: min(x), "MAX": lambda *x: max(x)}[op](a, *rest)


def spelled(tree):
    if not isinstance(tree, tuple):
        return f"({tree})" if isinstance(tree, float) and tree < 0 else str(tree)
    op, *args = tree
    if op.isupper():
        return f"{op}({', '.join(map(spelled, args))})"
    return f"(not {spelled(args[0])})" if op == "not" else f"({spelled(args[0])} {op} {spelled(args[1])})"


def made(r, kind, depth):
    """A random expression of a kind (number or boolean) over the metrics x, y and gap, which has no data."""
    if kind == "number":
        if depth == 0 or r.random() < 0.2:
            return r.choice(["x", "y", "gap", 0.0, 1.5, 4.0, -2.0, 7.0])
        op = r.choice(["+", "-", "*", "/", "ABS", "MIN", "MAX", "CLAMP", "IF"])
        if op == "IF":
            return (op, made(r, "boolean", depth - 1), made(r, "number", depth - 1), made(r, "number", depth - 1))
        return (op, *(made(r, "number", depth - 1) for _ in range({"ABS": 1, "CLAMP": 3}.get(op, 2))))
    if depth == 0 or r.random() < 0.4:
        return (r.choice("<>"), made(r, "number", max(0, depth - 1)), made(r, "number", max(0, depth - 1)))
    op = r.choice(["and", "or", "not"])
    return (op, *(made(r, "boolean", depth - 1) for _ in range(1 if op == "not" else 2)))


def test_expressions_against_plain_python(spark):
    r = random.Random(11)
    metrics = {"x": 3.0, "y": -0.5}
    trees = [made(r, r.choice(["number", "boolean"]), r.randint(1, 3)) for _ in range(160)]
    found = [E.compile_expression(spelled(t), lambda m: F.lit(metrics.get(m)).cast("double")) for t in trees]
    row = spark.range(1).select(*(c for i, x in enumerate(found) for c in (x.value.alias(f"v{i}"), x.error.alias(f"e{i}")))).first()
    faults = 0
    for i, tree in enumerate(trees):
        try:
            want = plainly(tree, metrics)
        except Fault:
            faults += 1
            assert row[f"e{i}"] and row[f"v{i}"] is None, spelled(tree)
            continue
        assert row[f"e{i}"] is None and row[f"v{i}"] == (pytest.approx(want) if isinstance(want, float) else want), spelled(tree)
    assert 5 < faults < 80


@pytest.mark.parametrize(
    "source,out",
    [
        ("8 - 2 - 1", 5), ("6 + 8 / 4", 8), ("17 % 5", 2), ("-17 % 5", -2), ("7 > 6 AND not 5 > 6", True), ("IF(3 > 4, 1 / 0, 12)", 12), ("IF(4 > 3, 1 / 0, 12)", "division by zero"),
        ("flow * 2", None), ("flow > 3 or 9 > 8", True), ("9 < 8 and flow > 3", False), ("IF(flow > 3, 1, 2)", None), ("MIN(8, flow)", None), ("CLAMP(6, 30, 20)", "CLAMP: low is above high"),
        ("SQRT(0.25)", 0.5), ("SQRT(0 - 4)", "SQRT of a negative number"), ("POW(3, 4)", 81), ("25e-1 + .25", 2.75), ("3h", 10800e6), ("9 > 8 or 1 / 0 > 1", True),
    ],
)
def test_expressions(spark, source, out):
    assert run(spark, source) == out


@pytest.mark.parametrize("source", ["7 *", "x || y", "4 > 3 >", '"text"', "~x", "mean(4)", "AVG(8, 2h)", "RATE(flow, 9)", "3 or 4", "not 6", "SQRT(4, 9)", "IF(6, 7, 8)", "IF(6 > 7, 8)", "9q", "0.1.2", "(" * 130 + "7" + ")" * 130, "-" * 210 + "7", "7e888"])
def test_expression_faults(spark, source):
    with pytest.raises(E.ExpressionError):
        E.compile_expression(source, lambda m: F.lit(1.0))


def test_references():
    assert E.metric_refs(E.parse("DELTA(load, 2h) > speed or speed - level < load")) == ["load", "speed", "level"]
    with pytest.raises(E.ExpressionError):
        E.parse("speed load")


def test_lenient_and_registered(spark):
    found = E.compile_expression("3 or 4", lambda m: F.lit(1.0), lenient=True)
    assert spark.range(1).select(found.error.alias("e")).first()["e"]
    E.register_function("twice", 1, 1, lambda a: E.Compiled(a.value * 2, a.error, E.NUMBER))
    assert run(spark, "twice(4)") == 8
