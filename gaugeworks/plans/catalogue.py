"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.config import DerivedMetric, Metric, Rule, Settings, dimensions, local_table
from gaugeworks.functions import expression, text, times, units
from gaugeworks.operators import current, dedup, gaps, lateness, normalize, quantiles, rolling, rules, scan, stored, validate, windows
from gaugeworks.plans import ingest
from gaugeworks.plans import samples as S
from gaugeworks.shipping import ship
from gaugeworks.sources.csv import read_csv
from gaugeworks.sources.jsonl import read_jsonl
from gaugeworks.sources.scratch import scratch, settled
from gaugeworks.sources.tlm import Reading, decode_files, encode
from gaugeworks.streaming import devices

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
HOUR, DAY = 3_600_000_000, 86_400_000_000


def add(name: str, query: Query, sql: str | None = None) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return query(spark, folder)

    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def rounded(frame: DataFrame, *names: str) -> DataFrame:
    return frame.withColumns({n: F.round(n, 6) + F.lit(0.0) for n in names})


def r(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


# Windows

STATS = ["min", "max", "avg", "sum", "stddev", "first_value", "last_value", "p50", "p95", "p99"]


def window_sql(sizes: str, source: str = S.DIRTY_SQL, period: int = 0) -> str:
    v = "FILTER (value IS NOT NULL AND quality <> 2)"
    return f"""
WITH s AS ({source}), w AS (SELECT s.*, z.size_us, event_time_us // z.size_us * z.size_us AS start_us FROM s, (SELECT unnest([{sizes}]) * 1000000::BIGINT AS size_us) z)
SELECT device_id, metric_id, CAST(size_us // 1000000 AS VARCHAR) || 's' AS window_type, start_us, start_us + size_us AS end_us, count(*) AS sample_count,
  count(*) {v} AS valid_count, count(*) FILTER (flags & 4 <> 0) AS synthetic_count, count(*) FILTER (quality = 2) AS bad_quality_count,
  CAST({f"greatest(0, size_us // {period} - count(*))" if period else "0"} AS BIGINT) AS missing_count,
  {r(f"min(value) {v}", "min")}, {r(f"max(value) {v}", "max")}, {r(f"avg(value) {v}", "avg")}, {r(f"sum(value) {v}", "sum")}, {r(f"stddev_pop(value) {v}", "stddev")},
  {r(f"first(value ORDER BY event_time_us, arrival) {v}", "first_value")}, min(event_time_us) {v} AS first_us,
  {r(f"first(value ORDER BY event_time_us DESC, arrival) {v}", "last_value")}, max(event_time_us) {v} AS last_us,
  {r(f"quantile_disc(value, 0.5) {v}", "p50")}, {r(f"quantile_disc(value, 0.95) {v}", "p95")}, {r(f"quantile_disc(value, 0.99) {v}", "p99")}
FROM w GROUP BY device_id, metric_id, size_us, start_us"""


def periods(spark: SparkSession, names: list[str], **settings) -> DataFrame:
    row = {"expected_period_us": None, "jitter_us": 0, "max_gap_us": None, "interpolation": "none"} | settings
    return local_table(spark, [(n, *row.values()) for n in names], "metric_id string, expected_period_us long, jitter_us long, max_gap_us long, interpolation string")


for size in (60, 300, 3600):
    add(f"window_stats_{size}s", lambda spark, folder, size=size: rounded(windows.aggregate(S.dirty(spark, folder), (size,)), *STATS), window_sql(str(size)))
add("window_multi_size", lambda spark, folder: rounded(windows.aggregate(S.dirty(spark, folder), (300, 3600, 86400)), *STATS), window_sql("300, 3600, 86400"))


def _stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The events as a stream into a store: the windows that close by their device's watermark, late rows worked in."""
    root = scratch(spark, "stream-windows")
    rows = S.clean(spark, folder, stream=True).withColumns({"sequence": F.col("sequence").cast("decimal(20,0)"), "tags": F.lit(None).cast("map<string,string>"), "file": F.lit(None).cast("string")})
    devices.store_stream(rows, DAY, (3600,), f"{root}/store", f"{root}/checkpoint").awaitTermination()
    return rounded(windows.current(ingest.read_aggregates(spark, f"{root}/store")).drop("version", "superseded"), *STATS)


add("stream_device_windows", _stream_windows, f"SELECT w.* FROM ({window_sql('3600', S.SQL)}) w WHERE end_us <= (SELECT max(event_time_us) - {DAY} FROM ({S.SQL}) t WHERE t.device_id = w.device_id)")


def _large_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """Quantiles of the events of each type and day over all devices: groups of any size."""
    rows = windows.assign(S.dirty(spark, folder).filter("quality <> 2"), (86400,))
    return rounded(quantiles.exact_quantiles(rows, ["metric_id", "start_us"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}), "p50", "p95", "p99")


add("window_quantiles_large", _large_quantiles, f"""
SELECT metric_id, event_time_us // {DAY} * {DAY} AS start_us, {r("quantile_disc(value, 0.5)", "p50")}, {r("quantile_disc(value, 0.95)", "p95")}, {r("quantile_disc(value, 0.99)", "p99")}
FROM ({S.DIRTY_SQL}) WHERE quality <> 2 GROUP BY ALL""")


def _every_type(spark: SparkSession, folder: str, **settings) -> DataFrame:
    """Settings for each event type that the table holds (a handful)."""
    return periods(spark, sorted(x[0] for x in S.events(spark, folder).select("event_type").distinct().collect()), **settings)


add("window_missing_count", lambda spark, folder: rounded(windows.aggregate(S.dirty(spark, folder), (3600, 86400), _every_type(spark, folder, expected_period_us=600_000_000)), *STATS), window_sql("3600, 86400", period=600_000_000))

V = "FILTER (value IS NOT NULL AND quality <> 2)"
add("sliding_windows", lambda spark, folder: rounded(windows.sliding(S.dirty(spark, folder), DAY, 6 * HOUR), "min", "max", "sum", "avg"), f"""
WITH s AS (SELECT *, event_time_us // {6 * HOUR} * {6 * HOUR} - k * {6 * HOUR} AS start_us FROM ({S.DIRTY_SQL}), (SELECT unnest(range(4)) AS k))
SELECT device_id, metric_id, CAST(start_us AS BIGINT) AS start_us, CAST(start_us + {DAY} AS BIGINT) AS end_us, count(*) AS sample_count, count(*) {V} AS valid_count, {r(f"min(value) {V}", "min")}, {r(f"max(value) {V}", "max")}, {r(f"sum(value) {V}", "sum")}, {r(f"avg(value) {V}", "avg")}
FROM s GROUP BY device_id, metric_id, s.start_us""")  # fmt: skip
add("session_windows", lambda spark, folder: rounded(windows.sessions(S.dirty(spark, folder), 6 * HOUR), "min", "max", "avg"), f"""
WITH s AS ({S.DIRTY_SQL}), o AS (SELECT *, coalesce(event_time_us - lag(event_time_us) OVER w > {6 * HOUR}, true) AS opens FROM s WINDOW w AS (PARTITION BY device_id, metric_id ORDER BY event_time_us)),
n AS (SELECT *, sum(opens::INT) OVER (PARTITION BY device_id, metric_id ORDER BY event_time_us) AS session FROM o)
SELECT device_id, metric_id, min(event_time_us) AS start_us, max(event_time_us) AS end_us, count(*) AS sample_count, count(*) {V} AS valid_count, {r(f"min(value) {V}", "min")}, {r(f"max(value) {V}", "max")}, {r(f"avg(value) {V}", "avg")} FROM n GROUP BY device_id, metric_id, session""")  # fmt: skip

# Lateness, order, duplicates

LATE_SQL = f"""
WITH s AS ({S.SQL}), w AS (SELECT *, max(event_time_us) OVER (PARTITION BY device_id ORDER BY arrival) - {DAY} AS watermark_us FROM s)
SELECT device_id, metric_id, event_time_us, sequence, watermark_us, CASE WHEN event_time_us < watermark_us THEN flags | 2 ELSE flags END AS flags FROM w"""
add("late_flags", lambda spark, folder: lateness.flag_late(S.clean(spark, folder), DAY).select("device_id", "metric_id", "event_time_us", "sequence", "watermark_us", "flags"), LATE_SQL)


def hot(rows: DataFrame) -> DataFrame:
    """Nine tenths of the rows on one device."""
    return rows.withColumn("device_id", F.when(F.col("arrival") % 10 != 0, "hot").otherwise(F.col("device_id")))


def hot_sql(source: str) -> str:
    return f"SELECT * REPLACE (CASE WHEN arrival % 10 <> 0 THEN 'hot' ELSE device_id END AS device_id) FROM ({source})"


add("late_flags_hot_device", lambda spark, folder: scan.flag_late_spread(hot(S.clean(spark, folder)), DAY).select("device_id", "metric_id", "event_time_us", "sequence", "watermark_us", "flags"), LATE_SQL.replace(S.SQL, hot_sql(S.SQL)))


def _seeded(spark: SparkSession, folder: str) -> DataFrame:
    rows = S.clean(spark, folder)
    seeds = lateness.stored_seeds(rows.filter("arrival % 10 = 0"))
    return lateness.flag_late(rows.filter("arrival % 10 <> 0"), DAY, seeds).filter("flags & 2 <> 0").groupBy("device_id").agg(F.count("*").alias("late"), F.max("watermark_us").alias("watermark_us"))


add("late_flags_seeded", _seeded, f"""
WITH s AS ({S.SQL}), z AS (SELECT device_id, max(event_time_us) AS seed FROM s WHERE arrival % 10 = 0 GROUP BY 1),
w AS (SELECT s.*, greatest(max(event_time_us) OVER (PARTITION BY s.device_id ORDER BY arrival), coalesce(seed, 0)) - {DAY} AS watermark_us FROM s LEFT JOIN z USING (device_id) WHERE arrival % 10 <> 0)
SELECT device_id, count(*) AS late, max(watermark_us) AS watermark_us FROM w WHERE event_time_us < watermark_us GROUP BY 1""")  # fmt: skip
FORCED_SQL = f"""
WITH RECURSIVE s AS ({S.SQL}), e AS (SELECT *, max(event_time_us) OVER (PARTITION BY device_id ORDER BY arrival) - {DAY} AS mark, row_number() OVER (PARTITION BY device_id ORDER BY arrival) AS n FROM s),
x AS (SELECT device_id, 0::BIGINT AS n, []::STRUCT(t BIGINT, a BIGINT)[] AS waiting, []::BIGINT[] AS forced FROM (SELECT DISTINCT device_id FROM e)
  UNION ALL SELECT device_id, n, CASE WHEN full_ THEN [] ELSE w END, CASE WHEN full_ THEN list_transform(w, lambda z: z.a) ELSE [] END FROM (SELECT *, NOT late AND len(w) >= 6 AS full_ FROM (
    SELECT e.device_id, e.n, e.event_time_us < e.mark AS late, CASE WHEN e.event_time_us < e.mark THEN waiting ELSE list_filter(list_append(waiting, struct_pack(t := e.event_time_us, a := e.arrival)), lambda z: z.t > e.mark) END AS w FROM x JOIN e ON e.device_id = x.device_id AND e.n = x.n + 1))),
f AS (SELECT DISTINCT unnest(forced) AS arrival, 8 AS forced FROM x)
SELECT device_id, arrival, CAST(CASE WHEN event_time_us < mark THEN flags | 2 ELSE flags | coalesce(forced, 0) END AS INTEGER) AS flags FROM e LEFT JOIN f USING (arrival)"""
add("forced_flush", lambda spark, folder: lateness.flag_forced(S.clean(spark, folder), DAY, 6).select("device_id", "arrival", "flags"), FORCED_SQL)
add("emission_order", lambda spark, folder: lateness.emission_rank(S.clean(spark, folder).withColumn("sequence", F.when(F.col("arrival") % 3 != 0, F.col("sequence")))).select("device_id", "arrival", F.col("emitted").cast("long").alias("emitted")), f"""
WITH s AS ({S.SQL}) SELECT device_id, arrival, row_number() OVER (PARTITION BY device_id ORDER BY event_time_us, arrival % 3 = 0, CASE WHEN arrival % 3 <> 0 THEN sequence END, arrival) AS emitted FROM s""")  # fmt: skip


def _twice(rows: DataFrame, sequenced: bool) -> DataFrame:
    """Each fifth row comes once more, later; with a sequence its time and value differ."""
    if sequenced:
        again = rows.filter("arrival % 5 = 0").withColumns({"event_time_us": F.col("event_time_us") + 1000, "value": F.col("value") + 1, "arrival": F.col("arrival") + 1_000_000_000})
        return rows.unionByName(again)
    rows = rows.withColumn("sequence", F.lit(None).cast("bigint"))
    return rows.unionByName(rows.filter("arrival % 5 = 0").withColumn("arrival", F.col("arrival") + 1_000_000_000))


def _dedup_sql(again: str, key: str, sequence: str) -> str:
    return f"""
WITH s AS ({S.DIRTY_SQL}), a AS (SELECT * REPLACE ({sequence} AS sequence) FROM (SELECT * FROM s UNION ALL SELECT * REPLACE ({again}) FROM s WHERE arrival % 5 = 0)),
n AS (SELECT *, row_number() OVER (PARTITION BY device_id, metric_id, {key} ORDER BY event_time_us, sequence, arrival) AS k FROM a)
SELECT device_id, metric_id, event_time_us, arrival FROM n WHERE k = 1"""


add("dedup_seq", lambda spark, folder: dedup.dedup(_twice(S.dirty(spark, folder), True)).select("device_id", "metric_id", "event_time_us", "arrival"), _dedup_sql("event_time_us + 1000 AS event_time_us, value + 1 AS value, arrival + 1000000000 AS arrival", "sequence", "sequence"))
add("dedup_unseq", lambda spark, folder: dedup.dedup(_twice(S.dirty(spark, folder), False)).select("device_id", "metric_id", "event_time_us", "arrival"), _dedup_sql("arrival + 1000000000 AS arrival", "event_time_us, value", "NULL::BIGINT"))
add("dedup_history", lambda spark, folder: dedup.not_stored(S.dirty(spark, folder), S.dirty(spark, folder).filter("arrival % 7 = 0")).select("device_id", "metric_id", "arrival"), f"""
WITH s AS ({S.DIRTY_SQL}) SELECT device_id, metric_id, arrival FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.arrival % 7 = 0 AND o.device_id = s.device_id AND o.metric_id = s.metric_id AND o.sequence = s.sequence)""")  # fmt: skip

# Gaps and interpolation

STEP_SQL = f"""
s AS ({S.DIRTY_SQL}), v AS (SELECT * FROM s WHERE value IS NOT NULL AND quality <> 2),
o AS (SELECT *, row_number() OVER (PARTITION BY device_id, metric_id, event_time_us ORDER BY sequence, arrival) AS k FROM v),
l AS (SELECT device_id, metric_id, event_time_us AS t, value AS v, lag(event_time_us) OVER w AS prev_t, lag(value) OVER w AS prev_v FROM o WHERE k = 1 WINDOW w AS (PARTITION BY device_id, metric_id ORDER BY event_time_us)),
g AS (SELECT * FROM l WHERE t - prev_t > 4 * {HOUR}::BIGINT)"""


def _steps(spark: SparkSession, folder: str, how: str) -> DataFrame:
    return gaps.steps(S.dirty(spark, folder), _every_type(spark, folder, expected_period_us=3 * HOUR, jitter_us=HOUR, max_gap_us=DAY, interpolation=how))


add("gaps", lambda spark, folder: gaps.intervals(_steps(spark, folder, "none")), f"WITH {STEP_SQL} SELECT device_id, metric_id, prev_t AS start_us, t AS end_us, CAST((t - prev_t) // {3 * HOUR} - 1 AS BIGINT) AS expected_count FROM g")
POINT_SQL = f"g2 AS (SELECT *, unnest(generate_series(prev_t + {3 * HOUR}, t - 1, {3 * HOUR})) AS tp FROM g WHERE t - prev_t <= {DAY})"
add("interp_linear", lambda spark, folder: rounded(gaps.interpolate(_steps(spark, folder, "linear")), "value"), f"WITH {STEP_SQL}, {POINT_SQL} SELECT device_id, metric_id, tp AS event_time_us, {r('prev_v + (v - prev_v) * (CAST(tp - prev_t AS DOUBLE) / CAST(t - prev_t AS DOUBLE))', 'value')}, 0 AS quality, 4 AS flags FROM g2")
add("interp_previous", lambda spark, folder: rounded(gaps.interpolate(_steps(spark, folder, "previous")), "value"), f"WITH {STEP_SQL}, {POINT_SQL} SELECT device_id, metric_id, tp AS event_time_us, {r('prev_v', 'value')}, 0 AS quality, 4 AS flags FROM g2")
add("last_valid", lambda spark, folder: rounded(gaps.last_valid(S.dirty(spark, folder)), "value"), f"WITH s AS ({S.DIRTY_SQL}) SELECT device_id, metric_id, max(event_time_us) AS event_time_us, {r('max_by(value, event_time_us * 1.0 + value / 1e9)', 'value')} FROM s WHERE value IS NOT NULL AND quality <> 2 GROUP BY ALL")

# Rolling

ROLLING = ["mean", "low", "high", "stddev", "rate", "oldest", "newest"]


def _rolling(spark: SparkSession, folder: str, **limits) -> DataFrame:
    found = rolling.rolling(S.dirty(spark, folder), **limits)
    return rounded(found, *ROLLING).select("device_id", "metric_id", "arrival", "n", *ROLLING, "ready")


def rolling_sql(frame: str, least: int = 1) -> str:
    return f"""
WITH s AS (SELECT * FROM ({S.DIRTY_SQL}) WHERE value IS NOT NULL AND quality <> 2), f AS (SELECT device_id, metric_id, arrival, value, event_time_us AS t, count(*) OVER w AS n, avg(value) OVER w AS mean, min(value) OVER w AS low, max(value) OVER w AS high,
  stddev_pop(value) OVER w AS stddev, first_value(value) OVER w AS oldest, first_value(event_time_us) OVER w AS t0 FROM s WINDOW w AS (PARTITION BY device_id, metric_id {frame}))
SELECT device_id, metric_id, arrival, n, {r("mean", "mean")}, {r("low", "low")}, {r("high", "high")}, {r("CASE WHEN n < 2 THEN 0 ELSE stddev END", "stddev")},
  {r("CASE WHEN n < 2 OR t <= t0 THEN 0 ELSE (value - oldest) / ((t - t0) / 1e6) END", "rate")}, {r("oldest", "oldest")}, {r("value", "newest")}, n >= {least} AS ready FROM f"""


add("rolling_count", lambda spark, folder: _rolling(spark, folder, count=4, min_count=3), rolling_sql("ORDER BY event_time_us, arrival ROWS BETWEEN 3 PRECEDING AND CURRENT ROW", 3))
add("rolling_time", lambda spark, folder: _rolling(spark, folder, duration_us=2 * DAY), rolling_sql(f"ORDER BY event_time_us RANGE BETWEEN {2 * DAY} PRECEDING AND CURRENT ROW"))
BOTH = ["mean", "low", "high", "stddev", "rate", "oldest"]


def both_sql(count: int, duration: int) -> str:
    """Frames are lists of at most `count` rows, young ones kept."""
    return f"""
WITH s AS (SELECT * FROM ({S.DIRTY_SQL}) WHERE value IS NOT NULL AND quality <> 2), f AS (SELECT *, list(struct_pack(t := event_time_us, v := value)) OVER (PARTITION BY device_id, metric_id ORDER BY event_time_us, arrival ROWS BETWEEN {count - 1} PRECEDING AND CURRENT ROW) AS kept FROM s),
k AS (SELECT *, list_filter(kept, lambda x: x.t >= event_time_us - {duration}) AS ks FROM f), v AS (SELECT *, list_transform(ks, lambda x: x.v) AS vs, event_time_us - ks[1].t AS passed FROM k)
SELECT device_id, metric_id, arrival, len(vs) AS n, {r("list_avg(vs)", "mean")}, {r("list_min(vs)", "low")}, {r("list_max(vs)", "high")}, {r("CASE WHEN len(vs) < 2 THEN 0 ELSE list_stddev_pop(vs) END", "stddev")},
  {r("CASE WHEN len(vs) < 2 OR passed <= 0 THEN 0 ELSE (value - vs[1]) / (passed / 1e6) END", "rate")}, {r("vs[1]", "oldest")} FROM v"""


for name, count, duration in (("rolling_both", 3, DAY), ("rolling_both_wide", 1000, 20 * DAY)):
    add(name, lambda spark, folder, count=count, duration=duration: _rolling(spark, folder, count=count, duration_us=duration).select("device_id", "metric_id", "arrival", "n", *BOTH), both_sql(count, duration))

# Normalization

SEGMENTS = [(-1e9, 50.0, 2.0, 1.0), (50.0, 200.0, 0.5, 10.0)]
TARGETS = [("C", "K"), ("F", "C"), ("kPa", "bar"), ("bar", "kPa"), ("L/min", "m3/h"), ("mm/s", "m/s"), ("kW", "W")]


def _segments(spark: SparkSession, folder: str, reject: bool) -> DataFrame:
    rows = S.clean(spark, folder).select("device_id", "metric_id").distinct()
    listed = F.explode(F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(("seg_min", "seg_max", "slope", "intercept"), s, strict=True))) for s in SEGMENTS)))
    return rows.select("device_id", "metric_id", listed.alias("s")).select("device_id", "metric_id", "s.*", F.lit(reject).alias("reject_unmatched"))


CALIBRATE_SQL = "CASE WHEN value >= -1e9 AND value < 50 THEN 2.0::DOUBLE * value + 1.0::DOUBLE WHEN value >= 50 AND value < 200 THEN 0.5::DOUBLE * value + 10.0::DOUBLE ELSE value END"
add("calibrate", lambda spark, folder: rounded(normalize.calibrate(S.dirty(spark, folder), _segments(spark, folder, True)).select("arrival", "calibrated", "reject"), "calibrated"), f"WITH s AS ({S.DIRTY_SQL}) SELECT arrival, {r(CALIBRATE_SQL, 'calibrated')}, CASE WHEN value >= 200 THEN 'no calibration segment' END AS reject FROM s")


def _converted(spark: SparkSession, folder: str) -> DataFrame:
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("source"), F.lit(b).alias("target")) for a, b in TARGETS)))
    rows = S.clean(spark, folder).select("arrival", (F.col("value") - 100).alias("value"), pairs.alias("p")).select("arrival", "value", "p.*")
    out, error = units.convert(F.col("value"), F.col("source"), F.col("target"))
    return rounded(rows.select("arrival", "source", "target", out.alias("out"), error.alias("error")), "out")


def _converted_sql() -> str:
    parts = []
    for a, b in TARGETS:
        base = f"((value - 100) * CAST({next(u[2] for u in units.UNITS if u[0] == a)!r} AS DOUBLE) + CAST({next(u[3] for u in units.UNITS if u[0] == a)!r} AS DOUBLE))"
        parts.append(f"SELECT arrival, '{a}' AS source, '{b}' AS target, {r(f'CASE WHEN {base} >= 0 THEN ' + units.convert_expr('value - 100', a, b) + ' END', 'out')}, CASE WHEN {base} < 0 THEN 'below physical zero' END AS error FROM s")
    return f"WITH s AS ({S.SQL}) " + " UNION ALL ".join(parts)


add("convert_units", _converted, _converted_sql())


def _normalized(spark: SparkSession, folder: str) -> DataFrame:
    types = sorted(x[0] for x in S.events(spark, folder).select("event_type").distinct().collect())
    metrics = local_table(spark, [(t, "K", 270.0, 400.0) for t in types], "metric_id string, canonical_unit string, valid_min double, valid_max double")
    rows = S.dirty(spark, folder).withColumn("unit", F.lit("C"))
    return rounded(normalize.normalize(rows, _segments(spark, folder, False), metrics).select("arrival", "normalized_value", "reject"), "normalized_value")


NORMAL = f"({CALIBRATE_SQL} + 273.15::DOUBLE)"
add("normalize_chain", _normalized, f"WITH s AS ({S.DIRTY_SQL}) SELECT arrival, {r(f'CASE WHEN {NORMAL} >= 270 AND {NORMAL} <= 400 THEN {NORMAL} END', 'normalized_value')}, CASE WHEN {NORMAL} < 0 THEN 'below physical zero' WHEN {NORMAL} < 270 THEN 'below valid_min' WHEN {NORMAL} > 400 THEN 'above valid_max' END AS reject FROM s")


# Validation

INGEST_US = 1_704_067_200_000_000 + 20 * DAY


def _dimensions(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Settings' tables made from the events: every tenth user is unknown, every third may send the first two types alone."""
    types = sorted(x[0] for x in S.events(spark, folder).select("event_type").distinct().collect())
    out = dimensions(spark, Settings(metrics=tuple(Metric(t, "K", ("K", "C")) for t in types)))
    user = F.col("user_id")
    devices = S.events(spark, folder).filter("user_id % 10 <> 0").select("user_id").distinct().select(F.concat(F.lit("user-"), user.cast("string")).alias("device_id"), "user_id")
    tags = F.create_map(F.lit("line"), F.when(user % 2 == 0, "A").otherwise("B"), F.lit("zone"), (user % 5).cast("string"))
    out["devices"] = devices.select("device_id", F.when(user % 2 == 0, "UTC").otherwise("America/New_York").alias("timezone"), tags.alias("tags"))
    sent = F.when(user % 3 == 0, F.array(*map(F.lit, types[:2]))).otherwise(F.array(*map(F.lit, types)))
    out["device_metrics"] = devices.select("device_id", F.explode(sent).alias("metric_id"))
    return out


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """Input records with faults: bad identifiers, units, times, qualities and tags, by event_id."""
    rows = S.events(spark, folder)
    n = F.col("event_id")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    tags = F.when(n % 41 == 0, F.create_map(F.lit("bad key"), F.lit("v"))).when(n % 43 == 0, F.create_map(F.lit("k"), F.repeat(F.lit("x"), 129))).otherwise(F.create_map(F.lit("k"), F.lit("v")))
    return rows.select(
        F.when(n % 19 == 0, "bad id").otherwise(F.concat(F.lit("user-"), F.col("user_id").cast("string"))).alias("device_id"), F.when(n % 23 == 0, "no_such").otherwise(F.col("event_type")).alias("metric"),
        F.when(n % 29 == 0, "yesterday").when(n % 31 == 0, "99999999999999999").otherwise(ms.cast("string")).alias("event_time"), (n % 37 != 0).alias("has_value"), F.when(n % 47 == 0, F.lit(float("nan"))).when(n % 53 != 0, F.col("value")).alias("value"),
        F.when(n % 59 == 0, "Pa").when(n % 61 == 0, "").otherwise("C").alias("unit"), F.when(n % 67 == 0, 3).when(n % 3 == 0, 1).alias("quality"), F.lit(None).cast("decimal(20,0)").alias("sequence"), tags.alias("tags"),
        F.concat(F.lit("file-"), (n % 7).cast("string")).alias("file"), n.alias("position"),
    )


RECORD_SQL = f"""
r AS (SELECT event_id AS n, user_id AS u, event_type AS m, event_id % 7 AS f, CASE WHEN event_id % 19 = 0 THEN 'bad id' ELSE 'user-' || user_id END AS device_id, epoch_ms(ts) * 1000 AS us FROM events),
types AS (SELECT event_type AS m, row_number() OVER (ORDER BY event_type) AS k FROM (SELECT DISTINCT event_type FROM events)),
e AS (SELECT r.*, CASE WHEN n % 19 = 0 THEN 'format bad_device_id' WHEN n % 61 = 0 AND n % 59 <> 0 THEN 'format bad_unit_text' WHEN u % 10 = 0 THEN 'business unknown_device'
  WHEN n % 23 = 0 THEN 'business unknown_metric' WHEN u % 3 = 0 AND k > 2 THEN 'business metric_not_allowed' WHEN n % 29 = 0 THEN 'format bad_time' WHEN n % 31 = 0 THEN 'business invalid_time'
  WHEN us > {INGEST_US + 600_000_000} THEN 'business time_in_future' WHEN us < {INGEST_US - 15 * DAY} THEN 'business time_too_old' WHEN n % 37 = 0 THEN 'format missing_value' WHEN n % 47 = 0 THEN 'business value_not_finite'
  WHEN n % 59 = 0 THEN 'business unit_not_allowed' WHEN n % 67 = 0 THEN 'business bad_quality' WHEN n % 41 = 0 OR n % 43 = 0 THEN 'business bad_tags' END AS err FROM r JOIN types USING (m))"""


def _validated(spark: SparkSession, folder: str) -> DataFrame:
    return validate.validate(_records(spark, folder), _dimensions(spark, folder), INGEST_US, 15 * DAY)


add("validate_rows", lambda spark, folder: _validated(spark, folder).select("position", F.concat_ws(" ", "error.kind", "error.code").alias("err"), "quality"), f"WITH {RECORD_SQL} SELECT n AS position, coalesce(err, '') AS err, CAST(CASE WHEN n % 67 = 0 THEN 3 WHEN n % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS quality FROM e")
COUNT_SQL = "c AS (SELECT 'file-' || f AS file, count(*) AS total, count(*) FILTER (err IS NULL) AS accepted, count(*) FILTER (starts_with(err, 'format')) AS format_errors, count(*) FILTER (starts_with(err, 'business')) AS business_errors FROM e GROUP BY f)"
add("error_gate", lambda spark, folder: rounded(validate.gate(validate.file_counts(_validated(spark, folder)), 0.65, 100), "error_rate"), f"WITH {RECORD_SQL}, {COUNT_SQL} SELECT *, {r('business_errors / greatest(total, 100)', 'error_rate')}, CASE WHEN business_errors / greatest(total, 100) > 0.65 THEN 'QUARANTINED' ELSE 'VALIDATED' END AS status FROM c")

# Times


def _times(spark: SparkSession, folder: str) -> DataFrame:
    at = F.timestamp_micros(F.col("event_time_us"))
    rows = S.clean(spark, folder).select("arrival", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("body"), "event_time_us")
    form = F.pmod("arrival", F.lit(4))
    raw = F.when(form == 0, F.concat("body", F.lit("Z"))).when(form == 1, F.concat("body", F.lit("+08:00"))).when(form == 2, F.concat("body", F.lit("-0530"))).otherwise((F.expr("event_time_us div 1000")).cast("string"))
    parsed = times.parse_event_time(raw)
    return rows.select("arrival", parsed["us"].alias("us"), times.format_utc_us(parsed["us"]).alias("text"))


add("time_parse", _times, f"""
WITH s AS ({S.SQL}), t AS (SELECT arrival, event_time_us // 1000 * 1000 - CASE arrival % 4 WHEN 1 THEN 8 * {HOUR} WHEN 2 THEN -5.5 * {HOUR} ELSE 0 END AS us FROM s)
SELECT arrival, CAST(us AS BIGINT) AS us, strftime(make_timestamp(CAST(us AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS text FROM t""")  # fmt: skip


DST_DAYS = [("America/New_York", "2026-03-08"), ("America/New_York", "2026-11-01"), ("Australia/Lord_Howe", "2026-04-05"), ("Australia/Lord_Howe", "2026-10-04")]


def _zones(spark: SparkSession, folder: str) -> DataFrame:
    """Each event at a local time around a change of daylight saving in New York or on Lord Howe Island, which its number picks."""
    part = lambda by, n: F.pmod(F.floor(F.col("arrival") / by), F.lit(n)).cast("int")
    days = F.array(*(F.struct(F.lit(z).alias("zone"), F.lit(d).alias("day")) for z, d in DST_DAYS))
    rows = S.clean(spark, folder).select("arrival", F.get(days, part(1, 4)).alias("at"), part(4, 4).alias("h"), (part(16, 3) * 20).alias("m"))
    raw = F.concat("at.day", F.lit("T"), F.lpad(F.col("h").cast("string"), 2, "0"), F.lit(":"), F.lpad(F.col("m").cast("string"), 2, "0"), F.lit(":00"))
    early, late = times.parse_event_time(raw, F.col("at.zone")), times.parse_event_time(raw, F.col("at.zone"), earlier=False)
    return rows.select("arrival", "at.zone", raw.alias("raw"), early["us"].alias("earlier_us"), late["us"].alias("later_us"), early["error"].alias("error"))


def _zones_sql() -> str:
    """The events' local times, by the standard library's zones."""
    from datetime import UTC, datetime
    from zoneinfo import ZoneInfo

    rows = []
    for zone, day in DST_DAYS:
        for h in range(4):
            for m in (0, 20, 40):
                local = datetime.fromisoformat(f"{day}T{h:02}:{m:02}:00")
                us = [round(local.replace(tzinfo=ZoneInfo(zone), fold=fold).timestamp()) * 1_000_000 for fold in (0, 1)]
                skipped = datetime.fromtimestamp(us[0] / 1e6, UTC).astimezone(ZoneInfo(zone)).replace(tzinfo=None) != local
                values = ["NULL", "NULL", "'local time does not exist (DST gap)'"] if skipped else [str(us[0]), str(us[1]), "NULL"]
                rows.append(f"({len(rows)}, '{zone}', '{day}T{h:02}:{m:02}:00', {', '.join(values)})")
    known = f"(VALUES {', '.join(rows)}) t(k, zone, raw, a, b, e)"  # day, hour, third of an hour
    return f"SELECT arrival, zone, raw, CAST(a AS BIGINT) AS earlier_us, CAST(b AS BIGINT) AS later_us, CAST(e AS VARCHAR) AS error FROM ({S.SQL}) s JOIN {known} ON k = arrival % 4 * 12 + arrival // 4 % 4 * 3 + arrival // 16 % 3"


add("dst_policy", _zones, _zones_sql())


def _leap(spark: SparkSession, folder: str) -> DataFrame:
    """Each event's minute with a second of 60, in four forms, and with one of 61."""
    minute = F.date_format(F.timestamp_micros("event_time_us"), "yyyy-MM-dd'T'HH:mm")
    form = F.pmod("arrival", F.lit(5))
    raw = F.concat(minute, F.when(form == 0, ":60Z").when(form == 1, ":60.500Z").when(form == 2, ":60+02:00").when(form == 3, ":60-0930").otherwise(":61Z"))
    parsed = times.parse_event_time(raw)
    return S.clean(spark, folder).select("arrival", raw.alias("raw"), times.format_utc_us(parsed["us"]).alias("utc"), parsed["leap"].alias("leap"))


add("leap_second", _leap, f"""
WITH s AS (SELECT arrival, arrival % 5 AS form, date_trunc('minute', make_timestamp(event_time_us)) AS minute FROM ({S.SQL}))
SELECT arrival, strftime(minute, '%Y-%m-%dT%H:%M') || CASE form WHEN 0 THEN ':60Z' WHEN 1 THEN ':60.500Z' WHEN 2 THEN ':60+02:00' WHEN 3 THEN ':60-0930' ELSE ':61Z' END AS raw,
  CASE WHEN form < 4 THEN strftime(minute + to_microseconds(CAST(60000000 + CASE form WHEN 1 THEN 500000 WHEN 2 THEN -7200000000 WHEN 3 THEN 34200000000 ELSE 0 END AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%f') || 'Z' END AS utc,
  CASE WHEN form < 4 THEN true END AS leap FROM s""")  # fmt: skip

# Expressions


def _expressions(spark: SparkSession, folder: str, expressions: dict[str, str]) -> DataFrame:
    """Over each row's value (x) and quality of the row before (y, with nulls)."""
    rows = S.dirty(spark, folder).withColumn("y", F.when(F.col("arrival") % 5 != 0, F.col("arrival").cast("double") % 7 - 3))
    columns = {"x": F.col("value"), "y": F.col("y")}
    out = []
    for name, source in expressions.items():
        found = expression.compile_expression(source, lambda m: columns[m])
        out += [(F.round(found.value, 6) + 0.0 if found.kind == expression.NUMBER else found.value).alias(name), found.error.alias(f"{name}_error")]
    return rows.select("arrival", *out)


XY = f"WITH s AS ({S.DIRTY_SQL}), v AS (SELECT arrival, value AS x, CASE WHEN arrival % 5 <> 0 THEN CAST(arrival % 7 - 3 AS DOUBLE) END AS y FROM s)"
ZERO = "CASE WHEN x IS NOT NULL AND y = 0 THEN 'division by zero' END"
add("expr_scalar", lambda spark, folder: _expressions(spark, folder, {"a": "2 + 3 * x - -y", "b": "x / y", "c": "MAX(x, y, 1) + MIN(x, 50)", "d": "CLAMP(x, 10, 100)", "e": "ABS(y) + POW(y, 2) + SQRT(ABS(x))", "f": "x % 7"}), f"""
{XY} SELECT arrival, {r("2 + 3 * x + y", "a")}, NULL::VARCHAR AS a_error, {r("CASE WHEN y <> 0 THEN x / y END", "b")}, {ZERO} AS b_error,
  {r("CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN greatest(x, y, 1) + least(x, 50) END", "c")}, NULL::VARCHAR AS c_error, {r("CASE WHEN x IS NOT NULL THEN greatest(10, least(x, 100)) END", "d")}, NULL::VARCHAR AS d_error,
  {r("abs(y) + pow(y, 2) + sqrt(abs(x))", "e")}, NULL::VARCHAR AS e_error, {r("fmod(x, 7)", "f")}, NULL::VARCHAR AS f_error FROM v""")  # fmt: skip
add("expr_null_logic", lambda spark, folder: _expressions(spark, folder, {"a": "x > 50 and y > 0", "b": "x > 50 or y > 0", "c": "not (y == 1)", "d": "x > 50 or 1 / y > 0"}), f"""
{XY} SELECT arrival, x > 50 AND y > 0 AS a, NULL::VARCHAR AS a_error, x > 50 OR y > 0 AS b, NULL::VARCHAR AS b_error, NOT (y = 1) AS c, NULL::VARCHAR AS c_error,
  CASE WHEN coalesce(x > 50, false) THEN true WHEN y = 0 THEN NULL ELSE x > 50 OR 1 / nullif(y, 0) > 0 END AS d, CASE WHEN NOT coalesce(x > 50, false) AND y = 0 THEN 'division by zero' END AS d_error FROM v""")  # fmt: skip
add("expr_if_lazy", lambda spark, folder: _expressions(spark, folder, {"a": "IF(y != 0, x / y, -1)", "b": "IF(x > 50, 1, 2)"}), f"""
{XY} SELECT arrival, {r("CASE WHEN y <> 0 THEN x / y WHEN y = 0 THEN -1 END", "a")}, NULL::VARCHAR AS a_error, CASE WHEN x > 50 THEN 1.0::DOUBLE WHEN x <= 50 THEN 2.0::DOUBLE END AS b, NULL::VARCHAR AS b_error FROM v""")  # fmt: skip

# Current values, derived metrics

TWO_SQL = f"""
s AS ({S.DIRTY_SQL}), g AS (SELECT * FROM s WHERE value IS NOT NULL AND quality <> 2 AND metric_id IN ('click', 'purchase')),
i AS (SELECT device_id, event_time_us, max_by(value, arrival) FILTER (metric_id = 'click') AS a, max_by(value, arrival) FILTER (metric_id = 'purchase') AS b FROM g GROUP BY ALL),
c AS (SELECT device_id, event_time_us, a AS a0, b AS b0, last_value(a IGNORE NULLS) OVER w AS a, last_value(b IGNORE NULLS) OVER w AS b,
  last_value(CASE WHEN a IS NOT NULL THEN event_time_us END IGNORE NULLS) OVER w AS ta, last_value(CASE WHEN b IS NOT NULL THEN event_time_us END IGNORE NULLS) OVER w AS tb FROM i
  WINDOW w AS (PARTITION BY device_id ORDER BY event_time_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
add("asof_current_values", lambda spark, folder: rounded(current.current_values(S.dirty(spark, folder), ["click", "purchase"]), "click", "purchase"), f"WITH {TWO_SQL} SELECT device_id, event_time_us, {r('a', 'click')}, {r('b', 'purchase')} FROM c")
add("asof_hot_device", lambda spark, folder: rounded(scan.current_values_spread(hot(S.dirty(spark, folder)), ["click", "purchase"]), "click", "purchase"), f"WITH {TWO_SQL.replace(S.DIRTY_SQL, hot_sql(S.DIRTY_SQL))} SELECT device_id, event_time_us, {r('a', 'click')}, {r('b', 'purchase')} FROM c")
add("derived_recent", lambda spark, folder: rounded(current.derived(S.dirty(spark, folder), DerivedMetric("both", "click + 2 * purchase", "recent", 3 * DAY)), "value"), f"""
WITH {TWO_SQL} SELECT device_id, 'both' AS metric_id, event_time_us, {r(f"CASE WHEN event_time_us - ta <= {3 * DAY} THEN a END + 2 * CASE WHEN event_time_us - tb <= {3 * DAY} THEN b END", "value")} FROM c""")  # fmt: skip
add("derived_skip", lambda spark, folder: rounded(current.derived(S.dirty(spark, folder), DerivedMetric("half", "click / 2", "skip")), "value"), f"WITH {TWO_SQL} SELECT device_id, 'half' AS metric_id, event_time_us, {r('a0 / 2', 'value')} FROM c WHERE a0 IS NOT NULL")
add("expr_history", lambda spark, folder: rounded(current.evaluate(S.dirty(spark, folder), {"mean": "AVG(click, 5d)", "step": "DELTA(click, 5d)"}), "mean", "step"), f"""
WITH {TWO_SQL}, k AS (SELECT device_id, event_time_us, a0 AS a FROM c WHERE a0 IS NOT NULL), h AS (SELECT *, avg(a) OVER w AS mean, CASE WHEN count(a) OVER w >= 2 THEN last_value(a) OVER w - first_value(a) OVER w END AS step FROM k
  WINDOW w AS (PARTITION BY device_id ORDER BY event_time_us RANGE BETWEEN {5 * DAY} PRECEDING AND CURRENT ROW))
SELECT device_id, event_time_us, {r("mean", "mean")}, NULL::VARCHAR AS mean_error, {r("step", "step")}, NULL::VARCHAR AS step_error FROM h""")  # fmt: skip

# Rules


def _evaluated(spark: SparkSession, folder: str, *found: Rule) -> DataFrame:
    return rules.evaluations(S.dirty(spark, folder), [rules.compile_rule(x, ["click", "purchase"]) for x in found])


def island_sql(name: str, off: str, value: str = "a0", source: str = "a0 IS NOT NULL") -> str:
    return f"""
WITH {TWO_SQL}, e AS (SELECT device_id, event_time_us AS t, {value} AS v FROM c WHERE {source}), m AS (SELECT *, CASE WHEN v > 60 THEN 1 WHEN {off} THEN 0 END AS mark FROM e),
o AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY device_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS st FROM m),
p AS (SELECT *, CASE WHEN st = 1 AND coalesce(lag(st) OVER (PARTITION BY device_id ORDER BY t), 0) = 0 THEN 1 ELSE 0 END AS opens FROM o),
q AS (SELECT *, sum(opens) OVER (PARTITION BY device_id ORDER BY t) AS island FROM p)
SELECT '{name}' AS rule_id, device_id, min(t) AS started_us, min(t) FILTER (st = 0) AS ended_us, count(*) FILTER (v > 60) AS hit_count, CASE WHEN count(*) FILTER (v > 60) > 1 THEN max(t) FILTER (v > 60) END AS last_hit_us, {r("max(v) FILTER (v > 60)", "peak_value")}
FROM q WHERE island > 0 GROUP BY device_id, island"""


HIGH, BAND = Rule("high", "click > 60"), Rule("band", "click > 60", "click < 30")
add("rule_threshold_incidents", lambda spark, folder: rounded(rules.threshold_incidents(_evaluated(spark, folder, HIGH)), "peak_value"), island_sql("high", "v <= 60"))
add("rule_hysteresis", lambda spark, folder: rounded(rules.threshold_incidents(_evaluated(spark, folder, BAND)), "peak_value"), island_sql("band", "v < 30"))
add("rule_machine_threshold", lambda spark, folder: rounded(rules.incidents(rules.run_rules(_evaluated(spark, folder, BAND), [BAND])).select("rule_id", "device_id", "started_us", "ended_us", "hit_count", "last_hit_us", "peak_value"), "peak_value"), island_sql("band", "v < 30"))
FULL = Rule("full", "click > 40 and purchase > 40", "click < 30 or purchase < 30", severity="critical", duration_us=HOUR, cooldown_us=6 * HOUR, merge_interval_us=2 * DAY)


def machine_sql(select: str) -> str:
    """The machine of FULL as a recursion over a device's evaluations, one row after the other; `x` has every step's state.

    st: 0 normal, 1 pending, 2 firing, 3 recovering, 4 cooldown. o_: the open incident, l_: the one closed last."""
    fields = ("started", "hits", "last_hit", "peak", "reopened")
    fire, close, merges = "(go AND st1 IN (0, 1) AND cond AND st1 = 1 AND t - since1 >= %d)" % FULL.duration_us, "(go AND st1 = 3 AND recovered AND t - since1 >= %d)" % FULL.duration_us, f"(l_ended IS NOT NULL AND t - l_ended <= {FULL.merge_interval_us})"
    fresh = {"started": "t", "hits": "1", "last_hit": "NULL::BIGINT", "peak": "peak", "reopened": "0"}
    again = {"started": "l_started", "hits": "l_hits", "last_hit": "t", "peak": "greatest(l_peak, peak)", "reopened": "l_reopened + 1"}
    hit = {"hits": "o_hits + 1", "last_hit": "t", "peak": "greatest(o_peak, peak)"}
    hits = "(go AND st1 = 2 AND cond)"
    opened = ", ".join(f"CASE WHEN {close} THEN NULL WHEN {fire} THEN CASE WHEN {merges} THEN {again[f]} ELSE {fresh[f]} END" + (f" WHEN {hits} THEN {hit[f]}" if f in hit else "") + f" ELSE o_{f} END AS o_{f}" for f in fields)
    last = ", ".join(f"CASE WHEN {close} THEN o_{f} WHEN {fire} THEN NULL ELSE l_{f} END AS l_{f}" for f in fields)
    start = ", ".join(f"NULL::{'DOUBLE' if f == 'peak' else 'BIGINT'} AS {side}_{f}" for side in "ol" for f in fields)
    names = ", ".join(f"{side}_{f}" for side in "ol" for f in fields)
    return f"""
WITH RECURSIVE {TWO_SQL}, v AS (SELECT device_id, event_time_us AS t, a > 40 AND b > 40 AS trig, a < 30 OR b < 30 AS rec, coalesce(greatest(a, b), 0.0) AS peak FROM c),
e AS (SELECT device_id, t, trig IS NOT NULL AS has, coalesce(trig, false) AS cond, trig IS NOT NULL AND coalesce(rec, false) AS recovered, peak, row_number() OVER (PARTITION BY device_id ORDER BY t) AS n FROM v),
x AS (SELECT device_id, 0::BIGINT AS n, 0::BIGINT AS t, 0 AS st, 0::BIGINT AS since, NULL::VARCHAR AS event, {start}, NULL::BIGINT AS l_ended FROM (SELECT DISTINCT device_id FROM e)
UNION ALL SELECT device_id, n, t,
    CASE WHEN NOT go THEN st1 WHEN {fire} THEN 2 WHEN {close} THEN 4 WHEN st1 = 0 AND cond THEN 1 WHEN st1 = 1 AND NOT cond THEN 0 WHEN st1 = 3 AND NOT recovered THEN 2 WHEN st1 = 2 AND recovered THEN 3 ELSE st1 END,
    CASE WHEN NOT go THEN since1 WHEN {fire} OR {close} OR (st1 = 0 AND cond) OR (st1 = 1 AND NOT cond) OR (st1 = 3 AND NOT recovered) OR (st1 = 2 AND recovered) THEN t ELSE since1 END,
    CASE WHEN {close} THEN 'RECOVERED' WHEN {fire} AND {merges} THEN 'REOPENED' END, {opened}, {last}, CASE WHEN {close} THEN t WHEN {fire} THEN NULL ELSE l_ended END
  FROM (SELECT e.*, {names}, l_ended, CASE WHEN st = 4 AND e.t - since >= {FULL.cooldown_us} THEN 0 ELSE st END AS st1, CASE WHEN st = 4 AND e.t - since >= {FULL.cooldown_us} THEN e.t ELSE since END AS since1,
    e.has AND NOT (st = 4 AND e.t - since < {FULL.cooldown_us}) AS go FROM x JOIN e ON e.device_id = x.device_id AND e.n = x.n + 1)),
u AS (SELECT *, left(sha256('full' || chr(31) || '1' || chr(31) || device_id || chr(31) || coalesce(o_started, l_started)), 32) AS incident_uuid FROM x)
{select}"""


INCIDENT_SQL = """
, k AS (SELECT incident_uuid, device_id, n, o_started AS started_us, NULL::BIGINT AS ended_us, o_last_hit AS last_hit_us, o_hits AS hit_count, o_reopened AS reopen_count, o_peak AS peak_value FROM u WHERE o_started IS NOT NULL
  UNION ALL SELECT incident_uuid, device_id, n, l_started, l_ended, l_last_hit, l_hits, l_reopened, l_peak FROM u WHERE o_started IS NULL AND l_started IS NOT NULL)
SELECT incident_uuid, 'full' AS rule_id, 1 AS rule_version, device_id, 'critical' AS severity, CASE WHEN ended_us IS NULL THEN 'open' ELSE 'closed' END AS state, started_us, ended_us, CASE WHEN ended_us IS NOT NULL THEN 'RECOVERED' END AS close_reason,
  last_hit_us, CAST(hit_count AS BIGINT) AS hit_count, CAST(reopen_count AS BIGINT) AS reopen_count, peak_value FROM k QUALIFY row_number() OVER (PARTITION BY incident_uuid ORDER BY n DESC) = 1"""
HISTORY_SQL = "SELECT incident_uuid, t AS at_us, CASE event WHEN 'RECOVERED' THEN 'open' ELSE 'closed' END AS from_state, CASE event WHEN 'RECOVERED' THEN 'closed' ELSE 'open' END AS to_state, event AS reason FROM u WHERE event IS NOT NULL"
add("rule_full_machine", lambda spark, folder: rules.incidents(rules.run_rules(_evaluated(spark, folder, FULL), [FULL])), machine_sql(INCIDENT_SQL))
add("incident_history", lambda spark, folder: rules.incident_history(rules.run_rules(_evaluated(spark, folder, FULL), [FULL])), machine_sql(HISTORY_SQL))


def _resumed(spark: SparkSession, folder: str) -> DataFrame:
    """The incidents of FULL in two runs, the second from the first one's states."""
    found = _evaluated(spark, folder, FULL)
    ends = found.agg(F.min("event_time_us").alias("a"), F.max("event_time_us").alias("b")).first()
    first = settled(rules.run_rules(found.filter(F.col("event_time_us") <= (ends["a"] + ends["b"]) // 2), [FULL]))
    second = settled(rules.run_rules(found, [FULL], first))
    one, two = rules.incidents(first), rules.incidents(second)
    return one.join(two, "incident_uuid", "left_anti").unionByName(two)


add("rule_resumed", _resumed, machine_sql(INCIDENT_SQL))
add("open_incidents", lambda spark, folder: stored.query_incidents(rules.incidents(rules.run_rules(_evaluated(spark, folder, FULL), [FULL])), "open", "critical"), "SELECT * FROM (" + machine_sql(INCIDENT_SQL) + ") WHERE state = 'open' ORDER BY started_us DESC, rule_id, device_id LIMIT 1000")


def _told(spark: SparkSession, folder: str) -> DataFrame:
    output = settled(rules.run_rules(_evaluated(spark, folder, FULL), [FULL]))
    return stored.query_history(rules.incident_history(output), rules.incidents(output))


add("history_query", _told, machine_sql(HISTORY_SQL.replace("SELECT incident_uuid,", "SELECT incident_uuid, 'full' AS rule_id, device_id, 'critical' AS severity,")))
add("absence", lambda spark, folder: rules.absences(S.clean(spark, folder), 2 * DAY, INGEST_US + 12 * DAY), f"""
WITH s AS ({S.SQL}), t AS (SELECT DISTINCT device_id, event_time_us FROM s), n AS (SELECT *, lead(event_time_us) OVER (PARTITION BY device_id ORDER BY event_time_us) AS nx FROM t)
SELECT device_id, event_time_us + {2 * DAY} AS started_us, nx AS ended_us FROM n WHERE coalesce(nx, {INGEST_US + 12 * DAY}) - event_time_us > {2 * DAY}""")  # fmt: skip

# Versions, stored queries


def _versions(spark: SparkSession, folder: str) -> DataFrame:
    rows = S.dirty(spark, folder)
    late = rows.filter("arrival % 10 = 0")
    # read twice, so made once: each making holds buffers for its percentiles and joins
    first = settled(windows.aggregate(rows.filter("arrival % 10 <> 0"), (86400,)).withColumns({"version": F.lit(1), "superseded": F.lit(False)}))
    return rounded(windows.correct(first, rows, late, (86400,)), "sum").select("device_id", "metric_id", "start_us", "version", "superseded", "sample_count", "valid_count", "sum")


def _version_sql() -> str:
    v = "FILTER (value IS NOT NULL AND quality <> 2)"
    picked = f"device_id, metric_id, start_us, %s AS version, %s AS superseded, count(*) AS sample_count, count(*) {v} AS valid_count, {r(f'sum(value) {v}', 'sum')}"
    return f"""
WITH s AS (SELECT *, event_time_us // {DAY} * {DAY} AS start_us FROM ({S.DIRTY_SQL})), one AS (SELECT * FROM s WHERE arrival % 10 <> 0), late AS (SELECT DISTINCT device_id, metric_id, start_us, true AS hit FROM s WHERE arrival % 10 = 0),
touched AS (SELECT DISTINCT device_id, metric_id, start_us, hit FROM one JOIN late USING (device_id, metric_id, start_us))
SELECT {picked % ("1", "coalesce(any_value(hit), false)")} FROM one LEFT JOIN touched USING (device_id, metric_id, start_us) GROUP BY device_id, metric_id, start_us
UNION ALL SELECT {picked % ("2", "false")} FROM s JOIN touched USING (device_id, metric_id, start_us) GROUP BY device_id, metric_id, start_us"""


add("late_correction_versions", _versions, _version_sql())


def _imports(spark: SparkSession, folder: str) -> DataFrame:
    """Windows after two imports: each fourth event comes with the second, late or not."""
    rows, sizes = lateness.flag_late(S.dirty(spark, folder), DAY).drop("watermark_us"), (3600, 86400)
    first = settled(windows.aggregate(rows.filter("arrival % 4 <> 0"), sizes).withColumns({"version": F.lit(1), "superseded": F.lit(False)}))
    second = rows.filter("arrival % 4 = 0")
    fresh = settled(windows.recomputed(rows, windows.keys_of(second, sizes), sizes))
    changed = windows.changes(first, fresh, windows.keys_of(second.filter("flags & 2 <> 0"), sizes))
    return rounded(windows.apply(first, changed), "sum", "last_value").select("device_id", "metric_id", "window_type", "start_us", "version", "superseded", "sample_count", "valid_count", "sum", "last_value", "last_us")


def _imports_sql() -> str:
    v = "FILTER (value IS NOT NULL AND quality <> 2)"
    stats = f"count(*) AS sample_count, count(*) {v} AS valid_count, {r(f'sum(value) {v}', 'sum')}, {r(f'first(value ORDER BY event_time_us DESC, arrival) {v}', 'last_value')}, max(event_time_us) {v} AS last_us"
    key = "device_id, metric_id, window_type, start_us"
    return f"""
WITH w AS (SELECT *, event_time_us < max(event_time_us) OVER (PARTITION BY device_id ORDER BY arrival) - {DAY} AS late FROM ({S.DIRTY_SQL})),
z AS (SELECT w.*, size || 's' AS window_type, event_time_us // (size * 1000000) * (size * 1000000) AS start_us FROM w, (SELECT unnest([3600, 86400])::BIGINT AS size)),
k AS (SELECT {key}, bool_or(late) AS late FROM z WHERE arrival % 4 = 0 GROUP BY ALL), a AS (SELECT {key}, {stats} FROM z WHERE arrival % 4 <> 0 GROUP BY {key}),
b AS (SELECT {key}, {stats} FROM z SEMI JOIN k USING ({key}) GROUP BY {key})
SELECT {key}, 1 AS version, k.late IS NOT NULL AS superseded, a.* EXCLUDE ({key}) FROM a LEFT JOIN k USING ({key}) WHERE k.late IS NULL OR k.late
UNION ALL SELECT {key}, CASE WHEN k.late AND a.sample_count IS NOT NULL THEN 2 ELSE 1 END AS version, false AS superseded, b.* EXCLUDE ({key}) FROM b JOIN k USING ({key}) LEFT JOIN a USING ({key})"""


add("windows_after_imports", _imports, _imports_sql())


def _closed(spark: SparkSession, folder: str) -> DataFrame:
    rows = S.dirty(spark, folder)
    marks = rows.groupBy("device_id").agg((F.max("event_time_us") - DAY).alias("watermark_us"))
    return windows.closed(windows.aggregate(rows, (3600,)), marks).select("device_id", "metric_id", "start_us", "end_us", "sample_count")


add("windows_closed", _closed, f"""
WITH s AS ({S.DIRTY_SQL}), m AS (SELECT device_id, max(event_time_us) - {DAY} AS mark FROM s GROUP BY 1), w AS (SELECT device_id, metric_id, event_time_us // {HOUR} * {HOUR} AS start_us, count(*) AS sample_count FROM s GROUP BY ALL)
SELECT device_id, metric_id, start_us, start_us + {HOUR} AS end_us, sample_count FROM w JOIN m USING (device_id) WHERE start_us + {HOUR} <= mark""")  # fmt: skip
add("samples_query", lambda spark, folder: rounded(stored.query_samples(S.dirty(spark, folder), "user-1", "click", synthetic=False), "value"), f"WITH s AS ({S.DIRTY_SQL}) SELECT * REPLACE (round(value, 6) + 0.0 AS value) FROM s WHERE device_id = 'user-1' AND metric_id = 'click' AND flags & 4 = 0 ORDER BY event_time_us, arrival LIMIT 1000")
add("devices_by_tag", lambda spark, folder: stored.devices_by_tag(_dimensions(spark, folder)["devices"], line="A").select("device_id", "timezone", text.tags_json(F.col("tags")).alias("tags")), """
SELECT DISTINCT 'user-' || user_id AS device_id, 'UTC' AS timezone, '{"line":"A","zone":"' || user_id % 5 || '"}' AS tags FROM events WHERE user_id % 10 <> 0 AND user_id % 2 = 0""")  # fmt: skip
add("status_counts", lambda spark, folder: stored.status(validate.gate(validate.file_counts(_validated(spark, folder)), 0.65, 100)), f"WITH {RECORD_SQL}, {COUNT_SQL} SELECT CASE WHEN business_errors / greatest(total, 100) > 0.65 THEN 'QUARANTINED' ELSE 'VALIDATED' END AS status, count(*) AS files FROM c GROUP BY 1")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    gated = validate.gate(validate.file_counts(_validated(spark, folder)), 0.65, 100)
    return gated.select("file", F.concat(F.lit("/in/"), F.when(F.col("file") < "file-3", "a").otherwise("b")).alias("path"), "status", F.col("total").alias("first_seen_us"), F.col("file").alias("hash"))


FILE_SQL = f"WITH {RECORD_SQL}, {COUNT_SQL}, g AS (SELECT file, '/in/' || CASE WHEN file < 'file-3' THEN 'a' ELSE 'b' END AS path, CASE WHEN business_errors / greatest(total, 100) > 0.65 THEN 'QUARANTINED' ELSE 'VALIDATED' END AS status, total AS first_seen_us, file AS hash FROM c)"
add("files_by_status", lambda spark, folder: stored.files_in(_files(spark, folder), "QUARANTINED"), FILE_SQL + " SELECT * FROM g WHERE status = 'QUARANTINED'")
add("latest_file", lambda spark, folder: stored.latest_file(_files(spark, folder), "/in/a"), FILE_SQL + " SELECT * FROM g WHERE path = '/in/a' ORDER BY first_seen_us DESC, hash LIMIT 1")
add("disabled_devices", lambda spark, folder: stored.disabled_devices(S.clean(spark, folder).select("device_id").distinct(), _dimensions(spark, folder)["devices"]), "SELECT DISTINCT 'user-' || user_id AS device_id, user_id % 10 <> 0 AS enabled FROM events")


def _acknowledged(spark: SparkSession, folder: str) -> DataFrame:
    """Each second event as an incident, each third one acknowledged twice."""
    rows = S.clean(spark, folder).filter("arrival % 2 = 0").select(F.col("arrival").cast("string").alias("incident_uuid"), "device_id", "arrival")
    acks = rows.filter("arrival % 3 = 0").select("incident_uuid", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"), "arrival")
    acks = acks.select("incident_uuid", F.concat(F.lit("by-"), "k").alias("acked_by"), F.lit("seen").alias("ack_comment"), (F.col("arrival") + F.col("k")).alias("acked_us"))
    return stored.acknowledged(rows, acks)


add("acknowledged", _acknowledged, f"WITH s AS ({S.SQL}) SELECT CAST(arrival AS VARCHAR) AS incident_uuid, device_id, arrival, CASE WHEN arrival % 3 = 0 THEN 'by-2' END AS acked_by, CASE WHEN arrival % 3 = 0 THEN 'seen' END AS ack_comment, CASE WHEN arrival % 3 = 0 THEN arrival + 2 END AS acked_us FROM s WHERE arrival % 2 = 0")
add("samples_page", lambda spark, folder: stored.page(S.clean(spark, folder).select("device_id", "arrival"), 1000, 500, "arrival"), f"WITH s AS ({S.SQL}) SELECT device_id, arrival FROM s WHERE arrival > 1000 ORDER BY arrival LIMIT 500")
add("retention", lambda spark, folder: stored.retain(S.clean(spark, folder), 10, INGEST_US).groupBy("metric_id").agg(F.count("*").alias("n")), f"WITH s AS ({S.SQL}) SELECT metric_id, count(*) AS n FROM s WHERE event_time_us >= {INGEST_US - 10 * DAY} GROUP BY 1")
add("orphans", lambda spark, folder: stored.orphans(S.clean(spark, folder).select("device_id", "arrival"), _dimensions(spark, folder)["devices"], "device_id"), "SELECT 'user-' || user_id AS device_id, event_id AS arrival FROM events WHERE user_id % 10 = 0")

# Sources: the events written in a format and read again


def _input(spark: SparkSession, folder: str) -> DataFrame:
    """device_id, metric, event_time in ms, value (each 17th null), unit, quality, sequence, tags."""
    rows = S.dirty(spark, folder)
    return rows.select("device_id", F.col("metric_id").alias("metric"), F.expr("event_time_us div 1000").alias("event_time"), "value", F.lit("C").alias("unit"), (F.col("arrival") % 3).cast("int").alias("quality"), "sequence", F.create_map(F.lit("line"), F.concat(F.lit("L, "), F.col("device_id"))).alias("tags"))


def _read(records: DataFrame) -> DataFrame:
    rows = records.select("device_id", "metric", "event_time", "value", "unit", "quality", F.col("sequence").cast("long").alias("sequence"), text.tags_json(F.col("tags")).alias("tags"), "parse_error")
    return rounded(rows, "value")


def _csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    place = scratch(spark, "csv-scan")
    rows = _input(spark, folder)
    pairs = F.array_join(F.transform(F.map_entries("tags"), lambda t: F.concat(t["key"], F.lit("="), t["value"])), "|")
    rows.withColumn("tags", pairs).write.option("header", True).csv(place)
    return _read(read_csv(spark, [place]))


def _jsonl_scan(spark: SparkSession, folder: str) -> DataFrame:
    place = scratch(spark, "jsonl-scan")
    _input(spark, folder).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line")).write.text(place)
    return _read(read_jsonl(spark, [place]))


def _encoded(frame: pd.DataFrame) -> pd.DataFrame:
    readings = [Reading(r.device_id, r.metric, int(r.event_time), None if pd.isna(r.value) else float(r.value), r.unit, int(r.quality), int(r.sequence), dict(r.tags)) for r in frame.sort_values("sequence").itertuples()]
    return pd.DataFrame({"path": [frame["device_id"].iloc[0]], "content": [encode(readings, compress=True)]})


def _tlm_scan(spark: SparkSession, folder: str) -> DataFrame:
    return _read(decode_files(_input(spark, folder).groupBy("device_id").applyInPandas(_encoded, "path string, content binary")))


INPUT_SQL = f"""WITH s AS ({S.DIRTY_SQL}) SELECT device_id, metric_id AS metric, CAST(event_time_us // 1000 AS VARCHAR) AS event_time, {r("value", "value")}, 'C' AS unit, CAST(arrival % 3 AS INTEGER) AS quality, sequence, '{{"line":"L, ' || device_id || '"}}' AS tags, NULL::VARCHAR AS parse_error FROM s"""


def _fault_lines(spark: SparkSession, folder: str) -> DataFrame:
    """f, line of the four files, each sorted in one task. The lines, of which some are long, are made behind the sort, which holds short rows alone."""
    edges = [(f, -1, None, None, "device_id,metric,event_time,value,unit,sequence" if f < 3 else "device_id,metric") for f in range(4)] + [(f, 1 << 62, None, None, 'd,m,"open') for f in range(4)]
    rows = S.clean(spark, folder).select((F.col("arrival") % 4).alias("f"), F.col("arrival").alias("o"), "device_id", "metric_id", F.lit(None).cast("string").alias("edge"))
    rows = rows.unionByName(local_table(spark, edges, "f long, o long, device_id string, metric_id string, edge string"))
    n = F.col("o")
    unit = F.when(n % 7 == 0, F.lit('"C ""x""\ny"')).otherwise("C")
    head = F.concat("device_id", F.lit(","), "metric_id", F.lit(","))
    line = F.when(n % 5000 == 5, F.concat(head, F.expr("repeat('9', 1100000)"), F.lit(",1,C,"), n)).when(n % 11 == 0, F.concat(head, F.lit("5"))).otherwise(F.concat(head, n, F.lit(",1,"), unit, F.lit(","), n))
    line = F.when(n % 13 == 0, F.concat(line, F.lit('\n# a "comment'))).otherwise(line)
    return rows.repartition("f").sortWithinPartitions("f", "o").select("f", F.coalesce("edge", line).alias("line"))


def _csv_faults(spark: SparkSession, folder: str) -> DataFrame:
    """The events in four CSV files: quoted line breaks, comments with a quote, short and overlong records, a quote that stays open, a bad header."""
    place = scratch(spark, "csv-faults")
    _fault_lines(spark, folder).write.partitionBy("f").text(place)
    good = F.col("parse_error").isNull()
    return read_csv(spark, [place]).select(F.regexp_extract("file", "f=([0-9])", 1).alias("f"), "parse_error", F.when(good, F.col("sequence").cast("long")).alias("sequence"), F.when(good, F.col("unit")).alias("unit"))


add("csv_scan", _csv_scan, INPUT_SQL)
add("csv_faults", _csv_faults, f"""
WITH s AS (SELECT arrival, CASE WHEN arrival % 5000 = 5 THEN 'record too long' WHEN arrival % 11 = 0 THEN 'column count' END AS parse_error FROM ({S.SQL}) WHERE arrival % 4 < 3)
SELECT CAST(arrival % 4 AS VARCHAR) AS f, parse_error, CASE WHEN parse_error IS NULL THEN arrival END AS sequence, CASE WHEN parse_error IS NULL THEN CASE WHEN arrival % 7 = 0 THEN 'C "x"' || chr(10) || 'y' ELSE 'C' END END AS unit FROM s
UNION ALL SELECT CAST(f AS VARCHAR), 'unterminated quote', NULL, NULL FROM range(3) t(f)
UNION ALL SELECT '3', 'header: missing column event_time', NULL, NULL""")
add("jsonl_scan", _jsonl_scan, INPUT_SQL)
add("tlm_scan", _tlm_scan, INPUT_SQL)
