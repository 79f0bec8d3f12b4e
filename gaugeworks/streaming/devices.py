"""A stream of samples with a clock, a reorder buffer and windows for each device, as a batch has them.

Spark's own watermark is one for the whole query, so a device that lags behind the others would lose its rows. Here each device has
its state: its largest time so far, the rows that wait for it, and the windows that are open. A row before its device's watermark is late and
leaves at once; the others leave in order of time, sequenced rows first, then sequence and arrival, when the watermark reaches them. A
window closes when its device's watermark passes its end; what it holds is then made from the stored samples, so that its percentiles are
exact and the state holds no values of it.

A device is drained (its rows leave, its windows close) by an end mark, which is a row with a null time, or after idle_ms without
rows. Rows of a micro-batch count in order of arrival. Waiting rows lie in buckets of time, of which a micro-batch reads and writes
those alone that it releases or adds to; a window that opens and closes in one micro-batch never enters the state, since each access to
it is a call between processes. Rows leave the operator as lists, for the same reason. The state is typed and lies in RocksDB; a query that is started again goes on from it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from gaugeworks.operators import dedup
from gaugeworks.operators.lateness import LATE
from gaugeworks.plans import ingest
from gaugeworks.plans.history import History
from gaugeworks.shipping import ship
from gaugeworks.sources import tables
from gaugeworks.sources.scratch import remove, scratch, settled
from gaugeworks.streaming.imports import stream_commit

PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SAMPLE, WINDOW = "sample", "window"
#: Buckets of waiting rows in the length of the allowed lateness.
BUCKETS = 64
#: Rows in a list that leaves the operator, at most.
CHUNK = 1000


class DeviceClock(StatefulProcessor):
    """One device. sizes: window lengths in seconds."""

    def __init__(self, fields: T.StructType, lateness_us: int, sizes: tuple[int, ...], idle_ms: int | None):
        self.fields, self.lateness_us, self.sizes, self.idle_ms = fields, lateness_us, sizes, idle_ms
        self.width = max(lateness_us // BUCKETS, 1_000_000)
        self.place = {n: i for i, n in enumerate(fields.names)}
        self.time_at, self.sequence_at, self.arrival_at, self.metric_at, self.flags_at = (self.place[n] for n in ("event_time_us", "sequence", "arrival", "metric_id", "flags"))
        self.maps = [i for i, f in enumerate(fields) if isinstance(f.dataType, T.MapType)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "top long, emitted long")
        self.waiting = handle.getMapState("waiting", "bucket long", T.StructType([T.StructField("rows", T.ArrayType(self.fields))]))
        self.open = handle.getMapState("open", "metric_id string, size_us long, start_us long", "end_us long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        return self._lists(self._arrive(key, rows, timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._lists(self._drain(key))

    def _lists(self, found: Iterator[tuple]) -> Iterator[Row]:
        while part := list(islice(found, CHUNK)):
            yield Row(rows=part)

    def _arrive(self, key, rows, timerValues) -> Iterator[tuple]:
        arrived = sorted((self._with((*r, None), dict) for r in rows), key=lambda r: (self._time(r) is None, r[self.arrival_at] or 0))
        ends = bool(arrived) and self._time(arrived[-1]) is None
        arrived = [r for r in arrived if self._time(r) is not None]
        top, emitted = self.clock.get() or (None, 0)
        held, buckets = (set(), set()) if top is None else ({tuple(k) for k in self.open.keys()}, {b for (b,) in self.waiting.keys()})
        limit = max([self._time(r) for r in arrived] + ([] if top is None else [top]), default=None)
        if limit is not None:
            limit -= self.lateness_us
        due = {b for b in buckets if limit is not None and b <= limit // self.width}
        ready, later = self._take(due), {}
        opened, told = set(held), set()
        for n, row in enumerate(arrived):
            time = self._time(row)
            top = time if top is None else max(top, time)
            mark = top - self.lateness_us
            late = time < mark
            for window in self._windows(row):
                if window[1] + window[2] > mark:
                    opened.add(window)
                elif late and window not in opened:
                    told.add(window)  # closed, or never open: the stored windows tell
            if late:
                emitted += 1
                yield self._sample(row, mark, emitted, True)
                continue
            entry = (*self._order(row), n, row, mark)
            if time <= limit:
                heapq.heappush(ready, entry)
            else:
                later.setdefault(time // self.width, []).append(self._kept(row, mark))
            while ready and ready[0][0] <= mark:
                entry = heapq.heappop(ready)
                emitted += 1
                yield self._sample(entry[-2], entry[-1], emitted, False)
        for entry in ready:
            later.setdefault(entry[0] // self.width, []).append(self._kept(entry[-2], entry[-1]))
        for bucket, added in later.items():
            before = self.waiting.getValue((bucket,))[0] if bucket in buckets - due else []
            self.waiting.updateValue((bucket,), ([*map(tuple, before), *added],))
        for window in sorted(opened):
            if limit is not None and window[1] + window[2] <= limit:
                if window in held:
                    self.open.removeKey(window)
                yield self._window(key, window, False)
            elif window not in held:
                self.open.updateValue(window, (window[1] + window[2],))
        for window in sorted(told):
            yield self._window(key, window, True)
        self.clock.update((top, emitted))
        if ends:
            yield from self._drain(key)
        elif self.idle_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def _with(self, row: tuple, kind: type) -> tuple:
        """The row with its maps as dict, which the state takes, or as a list of pairs, which Arrow takes."""
        if all(row[i] is None for i in self.maps):
            return row
        return tuple(v if v is None or i not in self.maps else dict(v) if kind is dict else list(v.items()) for i, v in enumerate(row))

    def _time(self, row: tuple) -> int | None:
        return row[self.time_at]

    def _order(self, row: tuple) -> tuple:
        sequence = row[self.sequence_at]
        return row[self.time_at], sequence is None, sequence or 0, row[self.arrival_at]

    def _windows(self, row: tuple) -> list[tuple[str, int, int]]:
        """metric, length and start; times before 1970 truncate towards zero, as in a batch."""
        time = self._time(row)
        return [(row[self.metric_at], size := s * 1_000_000, (abs(time) // size * size) * (1 if time >= 0 else -1)) for s in self.sizes]

    def _kept(self, row: tuple, mark: int) -> tuple:
        """A waiting row; its watermark on arrival stands behind its columns."""
        return (*row[: len(self.place) - 1], mark)

    def _take(self, buckets: set[int]) -> list[tuple]:
        """A heap of the waiting rows in these buckets, which leave the state."""
        out = []
        for bucket in buckets:
            for n, kept in enumerate(self.waiting.getValue((bucket,))[0]):
                row = (*tuple(kept)[:-1], None)
                out.append((*self._order(row), n - (1 << 40), row, kept[-1]))
            self.waiting.removeKey((bucket,))
        heapq.heapify(out)
        return out

    def _drain(self, key: tuple) -> Iterator[tuple]:
        if not self.clock.exists():
            return
        top, emitted = self.clock.get()
        ready = self._take({b for (b,) in self.waiting.keys()})
        while ready:
            entry = heapq.heappop(ready)
            emitted += 1
            yield self._sample(entry[-2], entry[-1], emitted, False)
        for window in sorted(tuple(k) for k in self.open.keys()):
            yield self._window(key, window, False)
        self.open.clear()
        self.clock.update((top, emitted))

    def _sample(self, row: tuple, mark: int, emitted: int, late: bool) -> tuple:
        values = [*self._with(row, list)[:-1], mark]
        values[self.flags_at] = (values[self.flags_at] or 0) | (LATE if late else 0)
        return (SAMPLE, *values, emitted, None, None, late)

    def _window(self, key: tuple, window: tuple, late: bool) -> tuple:
        values = [None] * len(self.place)
        values[self.place["device_id"]], values[self.metric_at] = key[0], window[0]
        return (WINDOW, *values, None, window[1], window[2], late)


def device_stream(samples: DataFrame, lateness_us: int, sizes: tuple[int, ...] = (), idle_ms: int | None = None) -> DataFrame:
    """Rows of two kinds. `sample`: the samples as they leave, with LATE flags, watermark_us and `emitted`, their place in the
    device's order. `window`: device_id, metric_id, size_us, start_us of a window that closes; or, with `late`, of a window before the
    watermark that a late row fell into."""
    ship(samples.sparkSession)
    samples.sparkSession.conf.set(*PROVIDER)
    fields = T.StructType([T.StructField(f.name, f.dataType) for f in samples.schema.fields] + [T.StructField("watermark_us", T.LongType())])
    extra = [("emitted", T.LongType()), ("size_us", T.LongType()), ("start_us", T.LongType()), ("late", T.BooleanType())]
    schema = T.StructType([T.StructField("kind", T.StringType()), *fields.fields, *(T.StructField(n, t) for n, t in extra)])
    lists = T.StructType([T.StructField("rows", T.ArrayType(schema))])
    return samples.groupBy("device_id").transformWithState(DeviceClock(fields, lateness_us, sizes, idle_ms), lists, "Append", "ProcessingTime" if idle_ms else "None").select(F.inline("rows"))


def store_stream(samples: DataFrame, lateness_us: int, sizes: tuple[int, ...], root: str, checkpoint: str, metrics: DataFrame | None = None, correction: bool = True, idle_ms: int | None = None) -> StreamingQuery:
    """Store a stream of samples (SAMPLES columns) as it leaves the devices' buffers, without duplicates, and the windows that close;
    then stop. Each micro-batch is one commit of the store, made once if it is tried again."""
    spark = samples.sparkSession

    def store(batch: DataFrame, number: int) -> None:
        with tables.commit(spark, root, stream_commit(checkpoint, number)) as under:
            if under is None:
                return
            # read again by the outer session: that of a stream with state has no adaptive execution, so all that is made of its rows had a task for each partition of the state
            kept, history = scratch(spark, "stream-batch"), History(spark, root, ingest.SAMPLES)
            batch.write.parquet(kept)
            rows = spark.read.schema(batch.schema).parquet(kept)
            new = settled(dedup.dedup(rows.filter(F.col("kind") == SAMPLE).select(*(c.split()[0] for c in ingest.SAMPLES.split(", ")))))
            tables.write_batch(dedup.not_stored(new, history.near(new)), f"{root}/samples", under, "event_time_us")
            history.add(tables.read_batch(spark, f"{root}/samples", ingest.SAMPLES, under), under)
            window = F.concat(F.expr("size_us div 1000000").cast("string"), F.lit("s")).alias("window_type")
            keys = rows.filter(F.col("kind") == WINDOW).select("device_id", "metric_id", window, "start_us", "late").distinct()
            ingest.store_windows(spark, root, under, sizes, keys.filter("not late").drop("late"), keys.filter("late").drop("late"), correction, metrics)
            remove(spark, kept)

    found = device_stream(samples, lateness_us, sizes, idle_ms)
    return found.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
