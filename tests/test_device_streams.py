"""Streams by device: rows, flags, order and windows as in a batch, for a device that lags as well, and after a restart."""

import heapq
import random
import time
from decimal import Decimal

import pytest

from gaugeworks.operators import lateness, windows
from gaugeworks.plans import ingest
from gaugeworks.sources import tables
from gaugeworks.streaming import devices

HOUR, DAY, LATENESS = 3_600_000_000, 86_400_000_000, 300_000_000
START = 1_788_220_800_000_000
SIZES = (60, 3600)


def readings(device, start, n, seed):
    """Rows about ten seconds apart, some of them long after their time, some without a sequence or a value."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        time = start + i * 10_000_000 - (r.randint(0, 900_000_000) if r.random() < 0.15 else r.randint(0, 90_000_000))
        rows.append((device, r.choice(["temp", "flow"]), time, None if r.random() < 0.05 else round(r.uniform(0, 100), 3), 0, 0, None if r.random() < 0.3 else Decimal(i), i, {"line": device} if r.random() < 0.5 else {}, "f"))
    return rows


def buffered(rows, ends):
    """What a device's buffer does with its rows, one after another: (arrival, watermark, late) in the order of leaving."""
    top, waiting, out = None, [], []
    order = lambda r: (r[2], r[6] is None, r[6] or 0, r[7])
    for r in rows:
        top = r[2] if top is None else max(top, r[2])
        mark = top - LATENESS
        if r[2] < mark:
            out.append((r[7], mark, True))
            continue
        heapq.heappush(waiting, (*order(r), mark))
        while waiting and waiting[0][0] <= mark:
            e = heapq.heappop(waiting)
            out.append((e[3], e[4], False))
    while ends and waiting:
        e = heapq.heappop(waiting)
        out.append((e[3], e[4], False))
    return out


@pytest.fixture
def feed(spark, tmp_path):
    """Writes a micro-batch; the stream of all of them."""
    n = iter(range(1000))

    def add(rows):
        spark.createDataFrame(rows, ingest.SAMPLES).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{next(n):03}"))

    def stream():
        schema = spark.createDataFrame([], ingest.SAMPLES).schema
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))

    return add, stream


def mark(device):
    return (device, *[None] * 9)


def test_order_and_flags(spark, feed, tmp_path):
    """Two devices in the same micro-batches, one a day behind, against the buffer played through; then the same rows in a batch."""
    add, stream = feed
    ahead, behind = readings("a", START, 700, 1), readings("b", START - DAY, 700, 2)
    cuts = [0, 5, 6, 300, 301, 700]

    def go():
        devices.device_stream(stream(), LATENESS, SIZES).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
        add([*ahead[x:y], *behind[x:y]])
        if k in (2, 4):
            go()  # each time a new query over the same checkpoint
    found = spark.read.parquet(str(tmp_path / "out"))
    batch = {(r.device_id, r.arrival): (r.watermark_us, r.flags) for r in lateness.flag_late(spark.createDataFrame([*ahead, *behind], ingest.SAMPLES), LATENESS).collect()}
    for device, rows in (("a", ahead), ("b", behind)):
        got = found.filter(f"kind = 'sample' and device_id = '{device}'").orderBy("emitted").collect()
        assert [(r.arrival, r.watermark_us, r.late) for r in got] == buffered(rows, False) and len({r.emitted for r in got}) == len(got) > 600
        assert all(batch[device, r.arrival] == (r.watermark_us, r.flags) for r in got)
        by = {r[7]: r for r in rows}
        wrong = [(x, y) for r in got if (x := (r.device_id, r.metric_id, r.event_time_us, r.value, r.quality, r.sequence, r.tags, r.file)) != (y := (*by[r.arrival][:5], *by[r.arrival][6:7], *by[r.arrival][8:]))]
        assert not wrong
    add([mark("a"), mark("b")])
    go()
    found = spark.read.parquet(str(tmp_path / "out"))
    for device, rows in (("a", ahead), ("b", behind)):
        assert [r.arrival for r in found.filter(f"kind = 'sample' and device_id = '{device}'").orderBy("emitted").collect()] == [x[0] for x in buffered(rows, True)]


def compare(spark, root, expected):
    """The current versions of the stored windows are the expected ones."""
    columns = [c for c in expected.columns]
    got = windows.current(ingest.read_aggregates(spark, root)).select(*columns)
    plain = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    assert plain(got.collect()) == plain(expected.collect())
    return got.count()


@pytest.mark.parametrize("correction", [True, False])
def test_windows_close_by_device(spark, feed, tmp_path, correction):
    add, stream = feed
    root = str(tmp_path / "store")
    ahead, behind = readings("a", START, 500, 3), readings("b", START - DAY, 500, 4)

    def go():
        devices.store_stream(stream(), LATENESS, SIZES, root, str(tmp_path / "cp"), correction=correction).awaitTermination()

    for x in range(0, 500, 125):
        add([*ahead[x : x + 125], *behind[x : x + 125]])
        if x in (125, 375):
            go()
    every = spark.createDataFrame([*ahead, *behind], ingest.SAMPLES)
    marks = every.groupBy("device_id").agg(({"event_time_us": "max"})).withColumnRenamed("max(event_time_us)", "top").selectExpr("device_id", f"top - {LATENESS} AS watermark_us")
    stored = tables.read_table(spark, f"{root}/samples", ingest.SAMPLES)
    if correction:  # late rows made their windows again
        assert compare(spark, root, windows.closed(windows.aggregate(stored, SIZES), marks)) > 100
        assert ingest.read_aggregates(spark, root).filter("version > 1").count() > 0
    else:
        assert ingest.read_aggregates(spark, root).filter("version > 1").count() == 0
        keys = windows.closed(windows.aggregate(stored, SIZES), marks).select(*windows.KEY)
        assert {tuple(r) for r in keys.collect()} == {tuple(r) for r in ingest.read_aggregates(spark, root).select(*windows.KEY).collect()}
    add([mark("a"), mark("b")])
    go()
    stored = tables.read_table(spark, f"{root}/samples", ingest.SAMPLES)
    assert stored.count() == every.dropDuplicates(["device_id", "arrival"]).count()
    if correction:
        compare(spark, root, windows.aggregate(stored, SIZES))


def test_idle_devices(spark, feed):
    """A device without rows for a while is drained by its timer."""
    add, stream = feed
    add(readings("a", START, 20, 5))
    query = devices.device_stream(stream(), DAY, (3600,), idle_ms=1).writeStream.format("memory").queryName("idle_rows").outputMode("append").trigger(processingTime="1 second").start()
    try:
        drained = lambda: spark.table("idle_rows").filter("kind = 'sample' and device_id = 'a'").count() == 20
        for _ in range(40):
            time.sleep(1)
            if drained():
                break
            add(readings("b", START, 1, 6))
        assert drained()
        assert spark.table("idle_rows").filter("kind = 'window' and device_id = 'a'").count() > 0
    finally:
        query.stop()
