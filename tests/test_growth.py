"""What keeps the memory of a task and the time of a query from growing with more than the rows."""

import re
from itertools import chain
from pathlib import Path

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions import times
from gaugeworks.operators import windows
from gaugeworks.plans import catalogue, ingest, samples
from gaugeworks.sources import tables, tlm
from gaugeworks.streaming import devices

FOLDER = "/root/testdata/sf0.001"


def test_lines_behind_the_sort(spark):
    """csv_faults: the one sort of a file holds no line, as some are over a megabyte."""
    found = catalogue._fault_lines(spark, FOLDER)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above, below = re.split(r"(?m)^.*\bSort \[.*$", plan)
    assert '# a "comment' in above and '# a "comment' not in below
    files = {f: [r.line for r in found.filter(f"f = {f}").collect()] for f in range(4)}
    assert all(x[-1] == 'd,m,"open' and x[0].startswith("device_id,") for x in files.values()) and max(map(len, files[1])) > 1_100_000


def test_one_making_of_corrected_windows(spark):
    """late_correction_versions: the touched windows are made once, and the task that makes them holds the buffers of that alone."""
    rows = samples.dirty(spark, FOLDER)
    first = spark.createDataFrame(windows.aggregate(rows.filter("arrival % 10 <> 0"), (86400,)).withColumns({"version": F.lit(1), "superseded": F.lit(False)}).collect(), ingest.AGGREGATES)
    found = windows.correct(first, rows, rows.filter("arrival % 10 = 0"), (86400,))
    assert len(re.findall(r"Aggregate \[.*percentile_?disc", found._jdf.queryExecution().optimizedPlan().toString())) == 1
    late = rows.filter("arrival % 10 = 0")
    want = windows.apply(first, windows.changes(first, windows.recomputed(rows, windows.keys_of(late, (86400,)).join(first.select(*windows.KEY).distinct(), windows.KEY, "left_semi"), (86400,)), windows.keys_of(late, (86400,)))).select(*first.columns)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))


def test_only_numbers_are_cast(spark):
    """dst_policy: times without an offset, or with Z, cost no failed cast, and the parts that guard the casts change no result."""
    raw = ["2026-03-08T01:00:00", "2026-03-08T01:00:00Z", "2026-03-08T01:00:00+0130", "2026-03-08T01:00:00-24:00", "2026-03-08T02:20:00", "2026-13-01T00:00:00", "1700000000000", "-", "", None]
    frame = spark.createDataFrame([(r,) for r in raw], "raw string")
    found = [(r.us, r.error) for r in frame.select(times.parse_event_time(F.col("raw"), F.lit("America/New_York")).alias("t")).select("t.us", "t.error").collect()]
    at = 1772928000_000_000  # 2026-03-08, UTC
    assert found[:4] == [(at + 6 * 3600_000_000, None), (at + 3600_000_000, None), (at - 1800_000_000, None), (None, "UTC offset out of range")]
    assert found[4:] == [(None, "local time does not exist (DST gap)"), (None, "time is not a supported format"), (1700000000000_000, None), (None, "time is not a supported format"), (None, "empty time"), (None, "empty time")]
    tree = times._read(F.struct(*(F.lit(None).cast(t).alias(n) for n, t in (("raw", "string"), ("zone", "string"), ("number", "boolean"), ("iso", "boolean"), ("seconds", "string"), ("offset", "string")))))
    assert not re.findall(r"(?i)(?<!THEN )try_cast\(", str(tree)) and re.findall(r"(?i)THEN try_cast\(", str(tree))


def test_repeated_texts_are_checked_once():
    """tlm_scan: the names and tags that all frames of a file repeat, and readings that share none of them."""
    readings = [tlm.Reading("d", "m", n, float(n), "C", 1, n, {"line": "L"}) for n in range(1000)]
    tlm._text.cache_clear()
    found = [r for _, r in tlm.decode(tlm.encode(readings, compress=True))]
    assert found == readings and tlm._text.cache_info().misses == 3
    found[0].tags["x"] = "y"
    assert found[1].tags == {"line": "L"} and next(tlm.decode(tlm.encode(readings[:1])))[1].tags == {"line": "L"}


def test_windows_of_one_micro_batch_stay_out_of_the_state(spark):
    """stream_device_windows: the state is asked for what is left after a micro-batch, not for each window that passes."""
    hour, calls = 3_600_000_000, []

    class Kept(dict):
        def updateValue(self, key, value):
            calls.append(key)
            self[key] = value

        def removeKey(self, key):
            calls.append(key)
            del self[key]

        def get(self):
            return self[0] if 0 in self else None

        def update(self, value):
            self[0] = value

        exists, containsKey, getValue = dict.__len__, dict.__contains__, dict.__getitem__

    fields = T.StructType([*spark.createDataFrame([], ingest.SAMPLES).schema.fields, T.StructField("watermark_us", T.LongType())])
    clock = devices.DeviceClock(fields, hour, (3600,), None)
    clock.clock, clock.waiting, clock.open = Kept(), Kept(), Kept()
    found, left = [], []
    for batch in (range(3000), range(3000, 3100)):
        rows = [("d", "m", n * hour, 1.0, 0, 0, None, n, None, None) for n in batch]  # one in each window
        lists = list(clock.handleInputRows(("d",), rows, None))
        found += chain.from_iterable(x.rows for x in lists)
        left.append((len(calls), len(lists)))
        assert max(len(x.rows) for x in lists) <= devices.CHUNK
    times = [x[3] for x in found if x[0] == devices.SAMPLE]
    assert times == [n * hour for n in range(3099)]  # the last one waits
    assert [x[-2] for x in found if x[0] == devices.WINDOW] == times[:-1]
    # two open windows and one waiting row are written; then they leave, and as many are written again
    assert left[0] == (3 + 0, 6) and left[1][0] == 3 + 6


def test_few_files_for_a_day(spark, tmp_path):
    """What is stored by day has a file for a day, not one for each task and day."""
    rows = spark.range(3000, numPartitions=16).selectExpr("id", "(id % 3) * 86400000000L AS at")
    tables.write_batch(rows, str(tmp_path / "t"), 1, "at")
    assert len(list(Path(tmp_path / "t").rglob("*.parquet"))) == 3
    assert sorted(r.id for r in tables.read_batch(spark, str(tmp_path / "t"), "id long, at long", 1).collect()) == list(range(3000))
