"""Rules of an import read few days: the same incidents and states as over all stored samples."""

import random

import pytest

from gaugeworks.config import Rule
from gaugeworks.operators import rules
from gaugeworks.plans import ingest
from gaugeworks.plans.history import History
from gaugeworks.sources import tables

HOUR, DAY = 3_600_000_000, 86_400_000_000
START = 20_000 * DAY
RULES = [Rule("both", "temp > 60 and flow > 50", "temp < 40", merge_interval_us=DAY), Rule("mean", "AVG(temp, 3h) > 55", duration_us=HOUR), Rule("slow", "flow + 0 * level > 80")]


def batches(seed):
    """A day each, of three devices: one silent for some days, one whose `level` comes once in a while, rows out of order and late."""
    r = random.Random(seed)
    for day in range(8):
        rows = []
        for device in ("a", "b", "c"):
            if device == "c" and 2 <= day <= 5:
                continue
            for i in range(24):
                metric = r.choice(["temp", "temp", "flow"])
                time = START + day * DAY + i * HOUR + r.randint(-2 * HOUR, 0) - (r.randint(1, 3) * DAY if r.random() < 0.06 else 0)
                rows.append((device, metric, time, None if r.random() < 0.05 else round(r.uniform(0, 100), 2), 2 if r.random() < 0.05 else 0, 0, None, day * 1000 + i, None, "f"))
            if device == "b" and day in (0, 6):
                rows.append((device, "level", START + day * DAY + 5 * HOUR, 3.0, 0, 0, None, day * 1000 + 99, None, "f"))
        yield rows


@pytest.mark.parametrize("seed", [1])
def test_same_as_over_all_samples(spark, tmp_path, seed):
    root, compiled = str(tmp_path / "store"), [rules.compile_rule(r, ["temp", "flow", "level"]) for r in RULES]
    history = History(spark, root, ingest.SAMPLES)
    before, read = spark.createDataFrame([], rules.OUTPUT), []
    for day, rows in enumerate(batches(seed)):
        new = spark.createDataFrame(rows, ingest.SAMPLES).coalesce(1)
        with tables.commit(spark, root, f"day={day}") as number:
            tables.write_batch(new, f"{root}/samples", number, "event_time_us")
            few = history.for_rules(new, number, compiled, before) if day else new
            history.add(new, number)
            whole = tables.read_table(spark, f"{root}/samples", ingest.SAMPLES, number=number)
            run = lambda samples, before=before: {repr(r) for r in rules.run_rules(rules.evaluations(samples, compiled), RULES, before).collect()}
            one, all_ = run(few), run(whole)
            states = {x for x in all_ if "kind='state'" in x}
            assert {x for x in one if "kind='incident'" in x} <= all_ and {x for x in all_ - one if "kind='incident'" in x} == set(), day
            assert {x for x in one if "kind='state'" in x} <= states
            read.append(few.count() / whole.count())
        out = spark.createDataFrame(rules.run_rules(rules.evaluations(whole, compiled), RULES, before).collect(), rules.OUTPUT)
        before = out
    assert min(read) < 1
