"""What an import needs of the stored samples, without reading them all.

heads: a row for each series with its newest time, its newest valid value and its largest sequence; a snapshot that each import writes anew, so
its size is that of the configured series, whatever the store's age. It gives the devices' watermarks and the seeds of gaps.

spans: the least and largest sequence of each series, day and commit. A row whose sequence is above its series' largest, or which has none and is newer
than its series, can't be stored already. For the others the days where it could be are known: its own day without a sequence, the days whose span
holds it with one; only these days of the samples are read.

Rules go on from their machines, so they need the samples from the first new instant on, as far back as their expressions look, and each
metric's last value before. Days are read from the one before; a metric without a value there has it in its head, and the few
devices for which the head is too new are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions.expression import longest_duration
from gaugeworks.operators.rules import CompiledRule
from gaugeworks.sources import tables
from gaugeworks.sources.scratch import settled

HEADS = "device_id string, metric_id string, top_us long, valid_us long, valid_value double, top_sequence decimal(20,0)"
SPANS = "device_id string, metric_id string, low decimal(20,0), high decimal(20,0), on_day string"
SERIES = ["device_id", "metric_id"]
DAY_US, FOREVER_US = 86_400_000_000, 250_000_000_000_000_000


@dataclass(frozen=True)
class History:
    """The committed samples of a store. samples: their schema."""

    spark: SparkSession
    root: str
    samples: str

    def heads(self) -> DataFrame:
        return tables.read_snapshot(self.spark, f"{self.root}/heads", HEADS)

    def seeds(self) -> DataFrame:
        """device_id, seed_us."""
        return self.heads().groupBy("device_id").agg(F.max("top_us").alias("seed_us"))

    def last_valid(self) -> DataFrame:
        """device_id, metric_id, event_time_us, value of each series' newest valid row."""
        return self.heads().filter("valid_us is not null").select(*SERIES, F.col("valid_us").alias("event_time_us"), F.col("valid_value").alias("value"))

    def days_near(self, rows: DataFrame) -> list[str]:
        """The days of the store where rows with the keys of these could be; at most one for each day stored."""
        heads = self.heads().select(*SERIES, "top_us", "top_sequence")
        old = rows.select(*SERIES, "event_time_us", "sequence").join(heads, SERIES).filter("(sequence is null and event_time_us <= top_us) or sequence <= top_sequence")
        asked = old.groupBy(*SERIES, F.when(F.col("sequence").isNull(), F.to_date(F.timestamp_micros("event_time_us")).cast("string")).alias("own_day")).agg(F.min("sequence").alias("first"), F.max("sequence").alias("last"))
        asked = settled(asked)
        days = {r[0] for r in asked.filter("own_day is not null").select("own_day").distinct().collect()}
        ranges = asked.filter("first is not null").drop("own_day")
        if not ranges.isEmpty():
            spans = tables.read_table(self.spark, f"{self.root}/spans", SPANS)
            days |= {r[0] for r in spans.join(ranges, SERIES).filter("low <= last and first <= high").select("on_day").distinct().collect()}
        return sorted(days)

    def near(self, rows: DataFrame) -> DataFrame:
        """The stored samples of those days."""
        return tables.read_table(self.spark, f"{self.root}/samples", self.samples, days=self.days_near(rows))

    def add(self, new: DataFrame, number: int) -> None:
        """Write the heads and spans of an import's samples, as part of its commit."""
        valid = F.max(F.when(F.col("value").isNotNull() & (F.col("quality") != 2), F.struct("event_time_us", "value"))).alias("valid")
        mine = new.groupBy(*SERIES).agg(F.max("event_time_us").alias("top_us"), valid, F.max("sequence").alias("top_sequence"))
        mine = mine.select(*SERIES, "top_us", F.col("valid.event_time_us").alias("valid_us"), F.col("valid.value").alias("valid_value"), F.col("top_sequence").cast("decimal(20,0)").alias("top_sequence"))
        both = self.heads().unionByName(mine).groupBy(*SERIES).agg(F.max("top_us").alias("top_us"), F.max(F.when(F.col("valid_us").isNotNull(), F.struct("valid_us", "valid_value"))).alias("valid"), F.max("top_sequence").alias("top_sequence"))
        tables.write_snapshot(both.select(*SERIES, "top_us", "valid.valid_us", "valid.valid_value", "top_sequence"), f"{self.root}/heads", number)
        day = F.to_date(F.timestamp_micros("event_time_us")).cast("string").alias("on_day")
        spans = new.filter("sequence is not null").groupBy(*SERIES, day).agg(F.min("sequence").alias("low"), F.max("sequence").alias("high"), F.min("event_time_us").alias("__us"))
        spans = spans.select(*SERIES, F.col("low").cast("decimal(20,0)").alias("low"), F.col("high").cast("decimal(20,0)").alias("high"), "on_day")
        tables.write_batch(spans, f"{self.root}/spans", number)

    def for_rules(self, new: DataFrame, number: int, compiled: list[CompiledRule], before: DataFrame) -> DataFrame:
        """Samples that give the rules' new evaluations. new: this commit's samples; before: rules.OUTPUT rows with the machines' states.

        A device whose rules all have states is evaluated after the earliest of their last evaluations, others from their first new sample on."""
        metrics = sorted({m for c in compiled for m in c.metrics})
        back = max((longest_duration(t) for c in compiled for t in (c.trigger, c.recovery) if t), default=0)
        states = before.filter((F.col("kind") == "state") & F.col("rule_id").isin([c.rule.id for c in compiled])).groupBy("device_id").agg(F.min("last_eval_us").alias("last_us"), F.count("*").alias("states"))
        mine = new.filter(F.col("metric_id").isin(metrics)).join(states, "device_id", "left")
        low = mine.filter(F.col("last_us").isNull() | (F.col("states") < len(compiled)) | (F.col("event_time_us") > F.col("last_us"))).agg(F.min("event_time_us")).first()[0]
        if low is None:
            return new.limit(0)
        start = ((low - back) // DAY_US - 1) * DAY_US
        path = f"{self.root}/samples"
        touched = settled(new.select("device_id").distinct())
        wanted = F.col("metric_id").isin(metrics)
        valid = F.col("value").isNotNull() & (F.col("quality") != 2)
        recent = tables.read_table(self.spark, path, self.samples, (start, FOREVER_US), number).filter(wanted).join(touched, "device_id", "left_semi")
        heads = self.heads().filter(wanted & F.col("valid_us").isNotNull()).join(touched, "device_id", "left_semi")
        known = recent.filter(valid & (F.col("event_time_us") < low - back)).select(*SERIES).distinct()
        far = settled(heads.filter(F.col("valid_us") >= low - back).join(known, SERIES, "left_anti").select("device_id").distinct())
        carried = heads.filter(F.col("valid_us") < start).select(*SERIES, F.struct(F.col("valid_us").alias("us"), F.col("valid_value").alias("v")).alias("last"))
        older = new.filter(wanted & valid & (F.col("event_time_us") < start)).select(*SERIES, F.struct(F.col("event_time_us").alias("us"), F.col("value").alias("v")).alias("last"))
        last = carried.unionByName(older).groupBy(*SERIES).agg(F.max("last").alias("last"))
        values = {"device_id": F.col("device_id"), "metric_id": F.col("metric_id"), "event_time_us": F.col("last.us"), "value": F.col("last.v"), "quality": F.lit(0), "flags": F.lit(0), "arrival": F.lit(-1).cast("long")}
        rows = recent.unionByName(last.select(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in recent.schema.fields))).join(far, "device_id", "left_anti")
        whole = tables.read_table(self.spark, path, self.samples, number=number).filter(wanted).join(far, "device_id", "left_semi")
        return rows if far.isEmpty() else rows.unionByName(whole)
