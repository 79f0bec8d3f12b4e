"""Rules on streams: typed state, started from imports' incidents, removed rules."""

import pytest

from gaugeworks.config import Rule
from gaugeworks.operators import rules
from gaugeworks.plans.samples import clean
from gaugeworks.streaming.rules import run_rules_stream

RULE = Rule("r", "click > 60", "click < 30", cooldown_us=3_600_000_000, merge_interval_us=86_400_000_000 * 3)


@pytest.fixture(scope="module")
def found(spark):
    return rules.evaluations(clean(spark, "/root/testdata/sf0.001"), [rules.compile_rule(RULE, ["click"])]).cache()


def stream(spark, folder, found, known, before=None):
    source = spark.readStream.schema(found.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder / "in"))
    run_rules_stream(source, known, before).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(folder / "out"))


def latest(frames):
    """The valid row of each incident: of several the one told last, which has the most hits and reopenings."""
    out = {}
    for frame in frames:
        for r in rules.incidents(frame).collect():
            rank = (r.reopen_count, r.hit_count, r.ended_us or 0)
            if r.incident_uuid not in out or rank >= out[r.incident_uuid][0]:
                out[r.incident_uuid] = (rank, r)
    return {k: r for k, (_, r) in out.items()}


def test_begins_from_an_import(spark, found, tmp_path):
    whole = {r.incident_uuid: r for r in rules.incidents(rules.run_rules(found, [RULE])).collect()}
    cuts = found.approxQuantile("event_time_us", [0.4, 0.7], 0)
    first = rules.run_rules(found.filter(f"event_time_us <= {cuts[0]}"), [RULE])
    for i, part in enumerate((f"event_time_us > {cuts[0]} and event_time_us <= {cuts[1]}", f"event_time_us > {cuts[1]}")):
        found.filter(part).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    told = stream(spark, tmp_path, found, [RULE], first)
    assert latest([first, told]) == whole and len(whole) > 3 and any(r.reopen_count for r in whole.values())


def test_removed_rule(spark, found, tmp_path):
    """The rule goes between two runs over one checkpoint: a row with a null time closes its open incidents, once."""
    middle = found.approxQuantile("event_time_us", [0.5], 0)[0]
    found.filter(f"event_time_us <= {middle}").coalesce(1).write.parquet(str(tmp_path / "in" / "p0"))
    before = latest([stream(spark, tmp_path, found, [RULE])])
    still = {k for k, r in before.items() if r.state == "open"}
    marks = found.select("rule_id", "device_id").distinct().selectExpr("rule_id", "device_id", "cast(null as bigint) event_time_us", "false has_data", "false condition", "false recovered", "0.0D peak")
    for i in (1, 2):
        marks.select(*found.columns).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    rows = [r for r in rules.incidents(stream(spark, tmp_path, found, [])).collect() if r.close_reason == "RULE_REMOVED"]
    assert still and {r.incident_uuid for r in rows} == still and len(rows) == len(still) and all(r.state == "closed" for r in rows)
