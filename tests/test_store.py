"""The store: commits that count whole or not at all, history that is read by day, retention by whole folders."""

import os
from decimal import Decimal

import pytest

from gaugeworks.plans import ingest
from gaugeworks.plans.history import History
from gaugeworks.sources import tables

from .test_sources import NOW, SETTINGS, add_readings

DAY = 86_400_000_000
START = 20_000 * DAY
TABLES = {"samples": ingest.SAMPLES, "intervals": ingest.INTERVALS, "aggregates": ingest.AGGREGATES, "files": ingest.FILES}


def state(spark, root):
    found = {t: sorted(map(repr, tables.read_table(spark, f"{root}/{t}", s).drop("path", "hash", "file").collect())) for t, s in TABLES.items()}
    return found | {"heads": sorted(map(repr, History(spark, root, ingest.SAMPLES).heads().collect())), "devices": sorted(map(repr, tables.read_snapshot(spark, f"{root}/devices", ingest.DEVICES).collect()))}


def test_all_or_nothing(spark, tmp_path, monkeypatch):
    """An import that breaks off at any of its writes leaves the state before it; tried again, it gives the state after it."""
    hour, root, other = 1788220800000, str(tmp_path / "a"), str(tmp_path / "b")
    first = add_readings(tmp_path / "x.csv", [(hour + 1000, 1.0), (hour + 400_000, 2.0)])
    second = add_readings(tmp_path / "y.csv", [(hour + 2000, 3.0), (hour + 400_000, 2.0), (hour + 86_400_000, 4.0)])
    for r in (root, other):
        ingest.import_files(spark, [first], SETTINGS, r, NOW + DAY)
    before = state(spark, root)
    ingest.import_files(spark, [second], SETTINGS, other, NOW + 2 * DAY)
    writes, real = [], {n: getattr(tables, n) for n in ("write_batch", "write_snapshot")}
    for stop in (0, 3, 6):  # the samples, the intervals, the devices
        writes.clear()
        for n, f in real.items():

            def broken(*args, f=f, stop=stop):
                f(*args)
                writes.append(args[1])
                if len(writes) > stop:
                    raise OSError("broken off")

            monkeypatch.setattr(tables, n, broken)
        with pytest.raises(OSError):
            ingest.import_files(spark, [second], SETTINGS, root, NOW + 2 * DAY)
        assert state(spark, root) == before, writes
    monkeypatch.undo()
    ingest.import_files(spark, [second], SETTINGS, root, NOW + 2 * DAY)
    assert state(spark, root) == state(spark, other) != before
    assert tables.latest(spark, root) == 2 and not [n for n in tables.names_in(spark, f"{root}/log") if n.endswith(".begun")]


def sample(day, sequence=None, value=1.0, device="d"):
    return (device, "m", START + day * DAY + 5, value, 0, 0, None if sequence is None else Decimal(sequence), 0, None, "f")


@pytest.fixture
def aged(spark, tmp_path):
    """A store of ten days, a commit and ten sequences each."""
    root = str(tmp_path / "store")
    history = History(spark, root, ingest.SAMPLES)
    for day in range(10):
        with tables.commit(spark, root, f"day={day}") as number:
            new = spark.createDataFrame([(*sample(day, 10 * day + i)[:2], START + day * DAY + i, float(i), *sample(day, 10 * day + i)[4:]) for i in range(10)], ingest.SAMPLES).coalesce(1)
            tables.write_batch(new, f"{root}/samples", number, "event_time_us")
            history.add(new, number)
    return root, history


def test_history_reads_few_days(spark, aged):
    """What an import reads doesn't grow with the store's age: rows that can't be stored read nothing, the others their days."""
    root, history = aged
    rows = lambda *x: spark.createDataFrame(x, ingest.SAMPLES)
    name = tables.day_of(START + 2 * DAY)
    assert history.days_near(rows(sample(10, 100), sample(3, 100), sample(10), sample(0, 5, device="new"))) == []
    assert history.days_near(rows(sample(10, 25), sample(10, 100))) == [name]
    assert history.days_near(rows(sample(2), sample(11))) == [name]
    read = history.near(rows(sample(10, 25)))
    assert read.count() == 10 and len(read.inputFiles()) == 1 and f"day={name}" in read.inputFiles()[0]
    assert history.near(rows(sample(10, 100))).inputFiles() == []
    assert [tuple(r) for r in history.seeds().collect()] == [("d", START + 9 * DAY + 9)]
    assert [tuple(r) for r in history.last_valid().collect()] == [("d", "m", START + 9 * DAY + 9, 9.0)]
    assert len(tables.names_in(spark, f"{root}/heads")) == 2


def test_days_and_numbers(spark, aged):
    root, _ = aged
    two = tables.read_table(spark, f"{root}/samples", ingest.SAMPLES, days=(START + DAY, START + 2 * DAY))
    assert two.count() == 20 and len(two.inputFiles()) == 2
    with tables.commit(spark, root, "day=3") as number:
        assert number is None  # a name counts once
    with pytest.raises(ValueError), tables.commit(spark, root, "new") as number:
        tables.write_batch(spark.createDataFrame([sample(50)], ingest.SAMPLES), f"{root}/samples", number, "event_time_us")
        assert tables.read_table(spark, f"{root}/samples", ingest.SAMPLES).count() == 100
        assert tables.read_table(spark, f"{root}/samples", ingest.SAMPLES, number=number).count() == 101
        raise ValueError
    with tables.commit(spark, root, "newer") as number:
        assert tables.read_batch(spark, f"{root}/samples", ingest.SAMPLES, number).count() == 0  # what was left there is gone
    assert tables.read_table(spark, f"{root}/samples", ingest.SAMPLES).count() == 100


def test_retention(spark, aged):
    root, _ = aged
    kept = [f for f in tables.read_table(spark, f"{root}/samples", ingest.SAMPLES).inputFiles() if f.split("day=")[1][:10] >= tables.day_of(START + 4 * DAY)]
    times = {f: os.stat(f.removeprefix("file://")).st_mtime_ns for f in kept}
    assert tables.retain(spark, root, "samples", START + 4 * DAY + 77) == [tables.day_of(START + k * DAY) for k in range(4)]
    found = tables.read_table(spark, f"{root}/samples", ingest.SAMPLES)
    assert found.count() == 60 and sorted(found.inputFiles()) == sorted(kept) and all(os.stat(f.removeprefix("file://")).st_mtime_ns == t for f, t in times.items())
    assert tables.retain(spark, root, "samples", START + 4 * DAY) == []
    with tables.commit(spark, root, f"retain=samples={tables.day_of(START + 6 * DAY)}"):
        pass  # and broken off before the folders went
    assert tables.read_table(spark, f"{root}/samples", ingest.SAMPLES).count() == 40


def test_compaction(spark, tmp_path):
    """Several imports into one day become one folder with the same rows, the newest of equal windows; a crash before the old ones go changes nothing."""
    hour, root = 1788220800000, str(tmp_path / "store")
    for i in range(3):
        ingest.import_files(spark, [add_readings(tmp_path / f"{i}.csv", [(hour + 1000 * i, float(i)), (hour + 600_000 + i, 5.0)])], SETTINGS, root, NOW + DAY + i)
    day = tables.day_of(hour * 1000)
    rows = lambda: {t: sorted(map(repr, f.collect())) for t, f in (("samples", tables.read_table(spark, f"{root}/samples", ingest.SAMPLES)), ("windows", ingest.read_aggregates(spark, root)))}
    before = rows()
    kept = tables.remove
    try:
        tables.remove = lambda spark, path: None if "number=" in path else kept(spark, path)
        assert tables.compact(spark, root, "samples", ingest.SAMPLES, day)
        assert rows() == before and len(tables.names_in(spark, f"{root}/samples/day={day}")) == 4  # the old ones are still there
    finally:
        tables.remove = kept
    assert tables.compact(spark, root, "samples", ingest.SAMPLES, day) and tables.compact(spark, root, "aggregates", ingest.AGGREGATES, day, ["device_id", "metric_id", "window_type", "start_us", "version"])
    assert rows() == before and [len(tables.names_in(spark, f"{root}/{t}/day={day}")) for t in ("samples", "aggregates")] == [1, 1]
    assert not tables.compact(spark, root, "samples", ingest.SAMPLES, day)
    assert ingest.import_files(spark, [add_readings(tmp_path / "4.csv", [(hour + 2000, 2.0), (hour + 3000, 9.0)])], SETTINGS, root, NOW + 2 * DAY)
    assert len(rows()["samples"]) == len(before["samples"]) + 1
