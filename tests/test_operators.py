"""Known answers of the operators, and plain Python beside them."""

import random

import pytest

from gaugeworks.config import ConfigError, DerivedMetric, Rule, from_dict
from gaugeworks.operators import current, dedup, gaps, lateness, normalize, rolling, rules, stored, windows

SCHEMA = "device_id string, metric_id string, event_time_us long, value double, quality int, flags int, sequence long, arrival long"
S = 1_000_000


def samples(spark, rows, device="dev-01", metric="temp"):
    """(seconds, value[, quality[, sequence]])"""
    full = [(device, metric, round(r[0] * S), r[1], r[2] if len(r) > 2 else 0, 0, r[3] if len(r) > 3 else None, i) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def metric(spark, period=10 * S, jitter=0, gap=None, how="none"):
    return spark.createDataFrame([("temp", period, jitter, gap, how)], "metric_id string, expected_period_us long, jitter_us long, max_gap_us long, interpolation string")


def test_window(spark):
    rows = samples(spark, [(100 + 10 * i, float(i + 1)) for i in range(6)])
    x = windows.aggregate(rows, (600,)).first()
    assert (x.sample_count, x.min, x.max, x.avg, x.sum, x.p50, x.p95, x.p99, x.window_type) == (6, 1, 6, 3.5, 21, 3, 6, 6, "600s")
    assert x.stddev == pytest.approx(1.707825127659933, abs=1e-12) and (x.first_value, x.last_value) == (1, 6)
    assert windows.aggregate(samples(spark, [(599, 1.0), (601, 2.0)]), (60,)).count() == 2
    assert windows.aggregate(samples(spark, [(-0.000001, 1.0)]), (60,)).first().start_us == 0
    bad = windows.aggregate(samples(spark, [(1, None), (2, 5.0, 2)]), (60,)).first()
    assert (bad.sample_count, bad.valid_count, bad.bad_quality_count, bad.min, bad.first_value) == (2, 0, 1, None, None)
    assert windows.aggregate(rows, (600,), metric(spark)).first().missing_count == 54


def test_late_correction(spark):
    rows = samples(spark, [(100 + i, 1.0) for i in range(5)] + [(150, 9.0)])
    first = windows.aggregate(rows.filter("arrival < 5"), (600,))
    from pyspark.sql import functions as F

    versions = first.withColumns({"version": F.lit(1), "superseded": F.lit(False)})
    out = {r.version: r for r in windows.correct(versions, rows, rows.filter("arrival = 5"), (600,)).collect()}
    assert (out[1].sample_count, out[1].superseded, out[2].sample_count, out[2].superseded) == (5, True, 6, False)
    assert windows.current(versions).first().sample_count == 5
    again = windows.upsert(versions, windows.aggregate(rows, (600,))).collect()
    assert [(r.version, r.sample_count) for r in again] == [(1, 6)]


def test_gaps(spark):
    x = gaps.intervals(gaps.steps(samples(spark, [(100, 1.0), (110, 1.0), (150, 1.0)]), metric(spark))).collect()
    assert [(r.start_us, r.end_us, r.expected_count) for r in x] == [(110 * S, 150 * S, 3)]
    x = gaps.steps(samples(spark, [(100, 1.0), (110, 99.0, 2), (120, 3.0)]), metric(spark, how="linear"))
    assert gaps.intervals(x).count() == 1 and [(r.event_time_us, r.value) for r in gaps.interpolate(x).collect()] == [(110 * S, 2.0)]


def test_interpolation(spark):
    rows = samples(spark, [(100, 10.0), (130, 40.0), (200, 0.0)])
    x = gaps.steps(rows, metric(spark, gap=35 * S, how="linear"))
    assert [(r.event_time_us // S, r.value, r.flags) for r in gaps.interpolate(x).orderBy("event_time_us").collect()] == [(110, 20.0, 4), (120, 30.0, 4)]
    assert gaps.intervals(x).count() == 2
    x = gaps.steps(samples(spark, [(100, 7.0), (120, 9.0)]), metric(spark, how="previous"))
    assert [(r.event_time_us // S, r.value) for r in gaps.interpolate(x).collect()] == [(110, 7.0)]
    long = gaps.interpolate(gaps.steps(samples(spark, [(0, 1.0), (100_000, 2.0)]), metric(spark, how="previous")))
    assert (long.count(), long.distinct().count()) == (9999, 9999) and long.agg({"event_time_us": "max"}).first()[0] == 99_990 * S
    seeds = gaps.last_valid(samples(spark, [(50, 1.0), (60, 2.0, 2)]))
    assert gaps.intervals(gaps.steps(samples(spark, [(100, 1.0)]), metric(spark), seeds)).first().start_us == 50 * S


def test_lateness(spark):
    rows = samples(spark, [(10.0, 1.0), (10.1, 1.0), (9.0, 1.0)])
    assert [r.flags for r in lateness.flag_late(rows, 1000).orderBy("arrival").collect()] == [0, 0, 2]
    seeds = spark.createDataFrame([("dev-01", 20 * S)], "device_id string, seed_us long")
    assert lateness.flag_late(samples(spark, [(10, 1.0)]), 0, seeds).first().flags == 2


@pytest.mark.parametrize("most,batch", [(3, 10_000), (5, 7), (100, 7)])
def test_forced(spark, most, batch):
    """Rows leave a full buffer early, as in the sequential form; batches of the Python side have no effect."""
    r = random.Random(5)
    rows = [(f"d{r.randint(0, 2)}", "m", (i // 3 + r.randint(-9, 9)) * S, float(i), 0, 0, None, i) for i in range(150)]
    top, waiting, flags = {}, {}, {}
    for d, _, t, *_, i in rows:
        top[d] = max(top.get(d, t), t)
        mark = top[d] - 5 * S
        flags[i] = 2 if t < mark else 0
        if flags[i]:
            continue
        waiting.setdefault(d, []).append((t, i))
        waiting[d] = [x for x in waiting[d] if x[0] > mark]
        if len(waiting[d]) >= most:
            for _, k in waiting[d]:
                flags[k] |= 8
            waiting[d] = []
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        found = lateness.flag_forced(spark.createDataFrame(rows, SCHEMA), 5 * S, most).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {x.arrival: x.flags for x in found} == flags and (most > 50 or any(x & 8 for x in flags.values()))


def test_dedup(spark):
    rows = samples(spark, [(1, 1.0, 0, 7), (2, 2.0, 0, 7), (1, 1.0), (1, 1.0), (1, 0.0), (1, -0.0), (1, None), (1, None)])
    assert sorted(r.arrival for r in dedup.dedup(rows).collect()) == [0, 2, 4, 6]
    assert dedup.not_stored(rows, rows.filter("arrival in (0, 2, 6)")).count() == 2


def test_calibration(spark):
    segments = spark.createDataFrame([("dev-01", "temp", -50.0, 0.0, 2.0, 1.0, False), ("dev-01", "temp", 0.0, 100.0, 0.5, 10.0, False)], "device_id string, metric_id string, seg_min double, seg_max double, slope double, intercept double, reject_unmatched boolean")
    rows = samples(spark, [(1, 10.0), (2, 0.0), (3, -50.0), (4, 100.0), (5, None)])
    assert [r.calibrated for r in normalize.calibrate(rows, segments).orderBy("arrival").collect()] == [15, 10, -99, 100, None]


def test_rolling(spark):
    rows = samples(spark, [(i / 1000, float(i + 1)) for i in range(5)])
    x = rolling.rolling(rows, count=4).orderBy("arrival").collect()
    assert (x[3]["mean"], x[4]["mean"], x[3]["rate"]) == (2.5, 3.5, 1000.0) and x[3]["stddev"] == pytest.approx(1.118033988749895)
    ties = samples(spark, [(1, 1.0), (1, 3.0), (2, 5.0)])
    assert [r["mean"] for r in rolling.rolling(ties, duration_us=S).orderBy("arrival").collect()] == [1.0, 2.0, 3.0]
    assert [r["n"] for r in rolling.rolling(ties, count=2, duration_us=0).orderBy("arrival").collect()] == [1, 2, 1]


@pytest.mark.parametrize("limits", [{"count": 3}, {"duration_us": 2 * S}, {"count": 3, "duration_us": 2 * S}])
def test_rolling_against_plain_python(spark, limits):
    """Nulls and device errors don't count; rows at one time and at the frame's edge."""
    r = random.Random(3)
    given = [(r.randint(0, 12) + r.choice([0, 0, 1e-6]), r.choice([None, 1.0, 2.5, 7.0]), r.choice([0, 0, 0, 2])) for _ in range(120)]
    got = {x.arrival: x for x in rolling.rolling(samples(spark, given), **limits, min_count=2).collect()}
    valid = sorted((round(t * S), i, v) for i, (t, v, q) in enumerate(given) if v is not None and q != 2)
    assert sorted(got) == sorted(i for _, i, _ in valid)
    for k, (t, i, v) in enumerate(valid):
        frame = valid[max(0, k + 1 - limits["count"]) if "count" in limits else 0 : k + 1]
        frame = [x for x in frame if x[0] >= t - limits.get("duration_us", 10**12)]
        values = [x[2] for x in frame]
        x, mean, passed = got[i], sum(values) / len(values), t - frame[0][0]
        assert (x.n, x.low, x.high, x.oldest, x.newest, x.ready) == (len(frame), min(values), max(values), values[0], v, len(frame) >= 2)
        assert (x["mean"], x.stddev) == pytest.approx((mean, (sum((y - mean) ** 2 for y in values) / len(values)) ** 0.5), abs=1e-9)
        assert x.rate == pytest.approx((v - values[0]) / (passed / 1e6) if passed > 0 else 0.0)


def feed(rule, steps):
    machine = rules.Machine(rule, "dev-01")
    for t, v in steps:
        machine.feed(t, v is not None, v is not None and v > 80, v is not None and (v < 75 if rule.recovery else not v > 80), v or 0.0)
    return list(machine.rows(True))


M = 60 * S


@pytest.mark.parametrize(
    "rule,steps,out",
    [  # (started, ended, hits, reopened)
        (Rule("r", "temp > 80"), [(1000, 85), (2000, 90), (3000, 70), (4000, 85)], [(1000, 3000, 2, 0), (4000, None, 1, 0)]),
        (Rule("r", "temp > 80", duration_us=5 * M), [(0, 85), (2 * M, 85), (4 * M, 70), (6 * M, 85), (10 * M, 85), (11 * M, 85)], [(11 * M, None, 1, 0)]),
        (Rule("r", "temp > 80", "temp < 75"), [(0, 85), (M, 78), (2 * M, 74)], [(0, 2 * M, 1, 0)]),
        (Rule("r", "temp > 80", merge_interval_us=10 * M), [(0, 85), (M, 70), (5 * M, 85), (6 * M, 70), (20 * M, 85)], [(0, 6 * M, 1, 1), (20 * M, None, 1, 0)]),
        (Rule("r", "temp > 80", cooldown_us=10 * M), [(0, 85), (M, 70), (2 * M, 85), (11 * M, 85)], [(0, M, 1, 0), (11 * M, None, 1, 0)]),
        (Rule("r", "temp > 80"), [(0, 85), (M, None), (2 * M, 70)], [(0, 2 * M, 1, 0)]),
        (Rule("r", "temp > 80", duration_us=2 * M), [(0, 85), (2 * M, 85), (3 * M, 70), (4 * M, 85), (5 * M, 70), (7 * M, 70)], [(2 * M, 7 * M, 1, 0)]),
    ],
)
def test_machine(rule, steps, out):
    found = [x for x in feed(rule, steps) if x[0] == "incident"]
    assert [(x[7], x[8], x[11], x[12]) for x in found] == out


def test_rules_end_to_end(spark):
    rows = samples(spark, [(0, 85.0), (60, 90.0), (120, 70.0), (180, 85.0)])
    rule = Rule("hot", "temp > 80", device_tags={"line": "A"})
    devices = spark.createDataFrame([("dev-01", {"line": "A"}), ("dev-02", {"line": "B"})], "device_id string, tags map<string,string>")
    other = rows.selectExpr("'dev-02' device_id", *[c for c in rows.columns if c != "device_id"])
    found = rules.evaluations(rows.unionByName(other), [rules.compile_rule(rule, ["temp"])], devices)
    output = rules.run_rules(found, [rule]).cache()
    got = sorted((r.started_us, r.state, r.hit_count, r.peak_value) for r in rules.incidents(output).collect())
    assert got == [(0, "closed", 2, 90.0), (180 * S, "open", 1, 85.0)]
    assert [(r.from_state, r.reason) for r in rules.incident_history(output).collect()] == [("open", "RECOVERED")]
    assert rules.close_removed(rules.incidents(output), [], 1).filter("close_reason = 'RULE_REMOVED'").count() == 1
    plain = rules.threshold_incidents(found).orderBy("started_us").collect()
    assert [(r.started_us, r.ended_us, r.hit_count) for r in plain] == [(0, 120 * S, 2), (180 * S, None, 1)]
    state = {r.kind: r.asDict() for r in output.collect()}["state"]
    # in two runs, the second from where the first stopped: the same incidents as in one
    first = rules.run_rules(found.filter(f"event_time_us <= {60 * S}"), [rule]).cache()
    second = rules.incidents(rules.run_rules(found, [rule], first)).collect()
    assert sorted(map(str, second)) == sorted(map(str, rules.incidents(output).collect()))
    again = rules.restored(rule, "dev-01", state, {r.incident_uuid: r.asDict() for r in output.filter("kind = 'incident'").collect()})
    again.feed(300 * S, True, False, True, 0.0)
    assert again.state == rules.NORMAL and again.last.started_us == 180 * S


def test_derived(spark):
    a, b = samples(spark, [(0, 10.0), (60, 20.0)], metric="a"), samples(spark, [(0, 1.0), (90, 2.0)], metric="b")
    both = a.unionByName(b.selectExpr("device_id", "metric_id", "event_time_us", "value", "quality", "flags", "sequence", "arrival + 10 arrival"))
    got = lambda policy, age=0: [(r.event_time_us // S, r.value) for r in current.derived(both, DerivedMetric("d", "a + b", policy, age)).orderBy("event_time_us").collect()]
    assert got("null") == [(0, 11.0), (60, None), (90, None)] and got("skip") == [(0, 11.0)]
    assert got("recent") == [(0, 11.0), (60, 21.0), (90, 22.0)] and got("recent", 40 * S) == [(0, 11.0), (60, None), (90, 22.0)]


def simulate(rows, lateness_us):
    """The sequential form of lateness and deduplication."""
    top, late, seen, kept = {}, [], set(), []
    for r in rows:
        top[r[0]] = max(top.get(r[0], r[2]), r[2])
        late.append(r[2] < top[r[0]] - lateness_us)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][2], rows[i][6] is None, rows[i][6] or 0, i))
    for i in order:
        d, m, t, v, *_, seq, _ = rows[i]
        key = (d, m, seq) if seq is not None else (d, m, t, "null" if v is None else v + 0.0, "u")
        if key not in seen:
            seen.add(key)
            kept.append(i)
    return late, sorted(kept)


@pytest.mark.parametrize("seed", range(3))
def test_against_simulation(spark, seed):
    r = random.Random(seed)
    rows = [(f"d{r.randint(0, 2)}", "m", r.randint(0, 60) * S, r.choice([None, 1.0, 2.0, -0.0, 0.0]), 0, 0, r.choice([None, None, r.randint(0, 9)]), i) for i in range(200)]
    frame = spark.createDataFrame(rows, SCHEMA)
    late, kept = simulate(rows, 20 * S)
    assert [x.flags == 2 for x in lateness.flag_late(frame, 20 * S).orderBy("arrival").collect()] == late
    assert sorted(x.arrival for x in dedup.dedup(frame).collect()) == kept


def test_stored(spark):
    rows = samples(spark, [(i, float(i)) for i in range(10)])
    assert [r.value for r in stored.query_samples(rows, "dev-01", "temp", 2 * S, 5 * S).collect()] == [2, 3, 4]
    assert stored.insert_or_ignore(rows.filter("arrival < 5"), rows.unionByName(rows), ["event_time_us"], ["arrival"]).count() == 5
    assert stored.retain(rows, 1, 86_400 * S + 5 * S).count() == 5
    incidents = spark.createDataFrame([("u1", "open", "critical", 5, "r", "d"), ("u2", "closed", "info", 9, "r", "d")], "incident_uuid string, state string, severity string, started_us long, rule_id string, device_id string")
    assert [r.incident_uuid for r in stored.query_incidents(incidents).collect()] == ["u2", "u1"]
    assert stored.query_incidents(incidents, "open", "critical").count() == 1
    assert stored.acknowledge(incidents, "u1", "me", "seen", 7).filter("acked_by = 'me' and state = 'open'").count() == 1
    devices = spark.createDataFrame([("a",), ("b",)], "device_id string")
    assert {r.device_id: r.enabled for r in stored.disabled_devices(devices, devices.filter("device_id = 'a'")).collect()} == {"a": True, "b": False}


def test_settings():
    good = {"schema_version": 1, "extra": 1, "metrics": [{"id": "t", "canonical_unit": "C", "input_units": ["C", "F"], "expected_period": "10s", "interpolation": "linear"}], "devices": [{"id": "d", "timezone": "Asia/Shanghai", "tags": {"line": "A"}}], "rules": [{"id": "r", "trigger": "t > 80", "duration": "5m"}]}
    settings = from_dict(good)
    assert settings.rules[0].duration_us == 300 * S and settings.unknown_keys == (".extra",) and settings.version() != from_dict(good | {"windows": [60]}).version()
    bad = {
        "schema_version": 2, "windows": [0], "pipeline": {"batch_size": 0, "max_error_rate": 2},
        "metrics": [{"id": "t", "canonical_unit": "C", "input_units": ["Pa"], "valid_min": 2, "valid_max": 1}, {"id": "t", "canonical_unit": "xx", "interpolation": "linear"}],
        "devices": [{"id": "d", "timezone": "Mars/X", "metrics": ["none"]}], "calibrations": [{"device": "d", "metric": "t", "segments": [{"min": 0, "max": 5, "slope": 1, "intercept": 0}, {"min": 4, "max": 9, "slope": 1, "intercept": 0}]}],
        "rules": [{"id": "r", "trigger": "q >", "duration": "soon"}], "derived_metrics": [{"id": "t", "expression": "u + 1", "missing_policy": "maybe"}],
    }
    with pytest.raises(ConfigError) as e:
        from_dict(bad)
    for part in ("schema_version", "windows", "batch_size", "max_error_rate", "different dimensions", "valid_min", "unknown unit", "needs expected_period", "time zone", "unknown metric none", "overlap", "duplicate metric id t", "unknown metric u", "missing_policy", "not a duration"):
        assert part in str(e.value), part
