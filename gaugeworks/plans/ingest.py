"""Files to stored samples, intervals and windows: parse, validate, gate, normalize, order, deduplicate, fill, aggregate."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.config import Settings, dimensions, local_table
from gaugeworks.functions.times import FORMAT
from gaugeworks.operators import dedup, gaps, lateness, normalize, rules, validate, windows
from gaugeworks.operators import stored as stored_rows
from gaugeworks.operators.dims import small
from gaugeworks.plans.history import History
from gaugeworks.shipping import ship
from gaugeworks.sources import tables
from gaugeworks.sources.csv import read_csv
from gaugeworks.sources.files import identity, place_of, put_away
from gaugeworks.sources.jsonl import read_jsonl
from gaugeworks.sources.records import format_of
from gaugeworks.sources.scratch import settled
from gaugeworks.sources.tlm import read_tlm

READERS = {"csv": read_csv, "jsonl": read_jsonl, "tlm": read_tlm}
SAMPLES = "device_id string, metric_id string, event_time_us long, value double, quality int, flags int, sequence decimal(20,0), arrival long, tags map<string,string>, file string"
INTERVALS = "device_id string, metric_id string, start_us long, end_us long, expected_count long"


AGGREGATES = (
    "device_id string, metric_id string, window_type string, start_us long, end_us long, sample_count long, valid_count long, synthetic_count long, bad_quality_count long, missing_count long, min double, max double, avg double, sum double, "
    "stddev double, first_value double, first_us long, last_value double, last_us long, p50 double, p95 double, p99 double, version int, superseded boolean"
)
FILES = "hash string, path string, status string, first_seen_us long"
DEVICES = "device_id string, enabled boolean"
EVALUATED = "rule_id string, rule_version int"
ACKS = "incident_uuid string, acked_by string, ack_comment string, acked_us long"
PLACES = 1 << 41  # rows of a file, for the arrival order of rows over files


@dataclass
class Stages:
    """What an import makes, before it is stored."""

    validated: DataFrame
    files: DataFrame
    samples: DataFrame
    intervals: DataFrame


def read_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """RECORD rows of files of any format."""
    by: dict[str, list[str]] = {}
    for p in paths:
        if not format_of(p):
            raise ValueError(f"{p}: unknown format")
        by.setdefault(format_of(p), []).append(p)
    return reduce(DataFrame.unionByName, (READERS[f](spark, sorted(ps)) for f, ps in sorted(by.items())))


def process(records: DataFrame, settings: Settings, ingest_us: int, history: History | None = None) -> Stages:
    """All stages over RECORD rows. history: the samples of earlier imports, for watermarks, duplicates and gaps.

    What is read more than once is written once, to the cluster's shared folder."""
    spark = records.sparkSession
    ship(spark)
    dims = dimensions(spark, settings)
    good = validate.validate(records.filter("parse_error is null").drop("parse_error"), dims, ingest_us, settings.history_range_us, settings.ambiguous_earlier)
    bad = records.filter("parse_error is not null").select(*(F.lit(None).cast(t).alias(n) if n in ("event_time_us",) else F.col(n) for n, t in good.drop("error").dtypes), F.struct(F.lit(FORMAT).alias("kind"), F.col("parse_error").alias("code")).alias("error"))
    # each of these is read several times by what follows
    validated = settled(good.unionByName(bad))
    files = settled(validate.gate(validate.file_counts(validated, "header: "), settings.max_error_rate, settings.error_rate_min_records))
    rows = validate.accepted(validated, files).withColumnRenamed("metric", "metric_id")
    rows = normalize.normalize(rows, dims["calibrations"], dims["metrics"]).filter("reject is null")
    # one arrival order over all files: by name, then place in the file; the table has a row for each file
    ranks = files.select("file", (F.row_number().over(Window.orderBy("file")) - 1).cast("bigint").alias("rank"))
    rows = rows.join(small(ranks), "file")
    arrival = (F.col("rank") * PLACES + F.col("position")).alias("arrival")
    rows = rows.select("device_id", "metric_id", "event_time_us", F.col("normalized_value").alias("value"), "quality", F.lit(0).alias("flags"), "sequence", arrival, "tags", "file")
    seeds = history.seeds() if history else None
    rows = lateness.flag_late(rows, settings.allowed_lateness_us, seeds).drop("watermark_us")
    rows = settled(dedup.dedup(rows))
    if history:
        rows = settled(dedup.not_stored(rows, history.near(rows)))
    found = gaps.steps(rows, dims["metrics"], history.last_valid() if history else None)
    points = gaps.interpolate(found).select("device_id", "metric_id", "event_time_us", "value", "quality", "flags", F.lit(None).cast("decimal(20,0)").alias("sequence"), F.lit((1 << 62)).cast("bigint").alias("arrival"), F.create_map().cast("map<string,string>").alias("tags"), F.lit(None).cast("string").alias("file"))
    return Stages(validated, files, dedup.dedup(rows.unionByName(points)), gaps.intervals(found))


def read_aggregates(spark: SparkSession, root: str, days: tuple[int, int] | None = None) -> DataFrame:
    """The stored windows, all versions. Each import adds the rows that it changes; of a window's version the last one counts."""
    rows = tables.read_table(spark, f"{root}/aggregates", AGGREGATES, days, numbered=True)
    w = Window.partitionBy(*windows.KEY, "version").orderBy(F.desc("written"))
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "written")


def store_aggregates(spark: SparkSession, settings: Settings, root: str, number: int, new: DataFrame) -> None:
    """Close or correct the windows that a commit's samples touch, over all stored samples; only the days they lie in are read."""
    is_late = F.col("flags").bitwiseAND(F.lit(lateness.LATE)) != 0
    on_time, late = (windows.keys_of(new.filter(x), settings.windows) for x in (~is_late, is_late))
    store_windows(spark, root, number, settings.windows, on_time, late, settings.late_correction, dimensions(spark, settings)["metrics"])


def store_windows(spark: SparkSession, root: str, number: int, sizes: tuple[int, ...], on_time: DataFrame, late: DataFrame, correction: bool, metrics: DataFrame | None = None) -> None:
    """Make windows over all stored samples and store what changes. on_time, late: windows.KEY, each once.

    Without correction a late row alone leaves a window that is stored as it is."""
    marked = settled(on_time.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True))))
    ends = marked.agg(F.min("start_us").alias("low"), F.max("start_us").alias("high")).first()
    if ends["low"] is None:
        return
    days = ends["low"], ends["high"] + max(sizes) * 1_000_000
    versions = read_aggregates(spark, root, days)
    hit, late = marked.drop("late").distinct(), marked.filter("late").drop("late")
    if not correction:
        hit, late = marked.filter("not late").drop("late").unionByName(late.join(versions.select(*windows.KEY).distinct(), windows.KEY, "left_anti")).distinct(), None
    samples = tables.read_table(spark, f"{root}/samples", SAMPLES, days, number)
    fresh = windows.recomputed(samples, hit, sizes, metrics)
    tables.write_batch(windows.changes(versions, fresh, late), f"{root}/aggregates", number, "start_us")


def read_incidents(spark: SparkSession, root: str) -> DataFrame:
    """The stored incidents and states of rules (rules.OUTPUT), each as the last import left it."""
    rows = tables.read_table(spark, f"{root}/rules", rules.OUTPUT, numbered=True)
    w = Window.partitionBy("kind", "rule_id", "device_id", F.when(F.col("kind") == "incident", F.col("incident_uuid"))).orderBy(F.desc("written"))
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "written")


def store_rules(spark: SparkSession, settings: Settings, root: str, number: int, ingest_us: int, new: DataFrame, history: History) -> None:
    """Go on with the rules' machines of the devices that a commit's samples touch; close the incidents of rules that are gone.

    The machines (states, open incidents, and of each rule and device the incident closed last) are a snapshot, as are the rules that
    have been evaluated: a rule that is new begins with all stored samples."""
    before = settled(tables.read_snapshot(spark, f"{root}/machines", rules.OUTPUT))
    if not settings.rules and before.isEmpty():
        return
    gone = before.filter("kind = 'incident' and state = 'open'")
    out = rules.close_removed(gone, [r.id for r in settings.rules], ingest_us).filter("close_reason = 'RULE_REMOVED' and state = 'closed'")
    closing = F.array(F.struct(F.lit(ingest_us).cast("bigint").alias("at_us"), F.lit("open").alias("from_state"), F.lit("closed").alias("to_state"), F.lit("RULE_REMOVED").alias("reason")))
    out = out.withColumn("history", F.concat("history", closing))
    if settings.rules:
        compiled = [rules.compile_rule(r, [m.id for m in settings.metrics]) for r in settings.rules]
        touched = settled(new.select("device_id").distinct())
        mine = settled(before.join(touched, "device_id", "left_semi"))
        told = {(r["rule_id"], r["rule_version"]) for r in tables.read_snapshot(spark, f"{root}/evaluated_rules", EVALUATED).collect()}
        if {(r.id, r.version) for r in settings.rules} <= told:
            samples = history.for_rules(new, number, compiled, mine)
        else:
            samples = tables.read_table(spark, f"{root}/samples", SAMPLES, number=number).join(touched, "device_id", "left_semi")
        found = rules.evaluations(samples, compiled, dimensions(spark, settings)["devices"])
        out = out.select(*before.columns).unionByName(rules.run_rules(found, list(settings.rules), mine).select(*before.columns))
    out = settled(out)
    tables.write_batch(out, f"{root}/rules", number)
    key = [*(F.col(c) for c in ("kind", "rule_id", "device_id")), F.when(F.col("kind") == "incident", F.col("incident_uuid"))]
    both = before.withColumn("__new", F.lit(0)).unionByName(out.select(*before.columns).withColumn("__new", F.lit(1)))
    both = both.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("__new")))).filter("__n = 1")
    # of the closed ones a machine may open the last again
    newest = F.row_number().over(Window.partitionBy("kind", "rule_id", "device_id", "state").orderBy(F.desc("ended_us")))
    kept = both.withColumn("__n", F.when((F.col("kind") == "incident") & (F.col("state") == "closed"), newest).otherwise(1)).filter("__n = 1")
    tables.write_snapshot(kept.select(*before.columns), f"{root}/machines", number)
    tables.write_snapshot(local_table(spark, sorted((r.id, r.version) for r in settings.rules), EVALUATED), f"{root}/evaluated_rules", number)


def store_devices(spark: SparkSession, settings: Settings, root: str, number: int) -> None:
    """All devices ever configured, enabled if they are now."""
    known = tables.read_snapshot(spark, f"{root}/devices", DEVICES)
    tables.write_snapshot(stored_rows.disabled_devices(known, dimensions(spark, settings)["devices"]), f"{root}/devices", number)


def store(records: DataFrame, settings: Settings, root: str, number: int, ingest_us: int) -> Stages:
    """Process RECORD rows and store them under a commit's number."""
    spark = records.sparkSession
    history = History(spark, root, SAMPLES)
    stages = process(records, settings, ingest_us, history)
    tables.write_batch(stages.samples, f"{root}/samples", number, "event_time_us")
    new = tables.read_batch(spark, f"{root}/samples", SAMPLES, number)
    history.add(new, number)
    tables.write_batch(stages.intervals, f"{root}/intervals", number, "start_us")
    store_aggregates(spark, settings, root, number, new)
    store_rules(spark, settings, root, number, ingest_us, new, history)
    store_devices(spark, settings, root, number)
    return stages


def import_files(spark: SparkSession, paths: list[str], settings: Settings, root: str, ingest_us: int, archive: str | None = None, quarantine: str | None = None) -> dict[str, str]:
    """Import files that aren't in the manifest yet; status by path. Each import is one commit: all its tables count, or none."""
    identities = {p: identity(p, spark) for p in paths}
    asked = local_table(spark, [(i.hash,) for i in identities.values()], "hash string")
    known = {r["hash"] for r in tables.read_table(spark, f"{root}/files", FILES).join(F.broadcast(asked), "hash", "left_semi").select("hash").distinct().collect()}
    new = {p: i for p, i in identities.items() if i.hash not in known}
    out = {p: "SKIPPED" for p in paths if p not in new}
    if not new:
        return out
    name = sorted(i.hash for i in new.values())[0][:16]
    with tables.commit(spark, root, f"import={name}={ingest_us}") as number:
        if number is None:
            return out | dict.fromkeys(new, "SKIPPED")
        stages = store(read_records(spark, sorted(new)), settings, root, number, ingest_us)
        files = {place_of(r["file"]): r for r in stages.files.collect()}
        status = {p: "QUARANTINED" if (r := files.get(place_of(p))) and r["status"] == "QUARANTINED" else "COMPLETED" for p in new}
        tables.write_batch(local_table(spark, [(i.hash, p, status[p], ingest_us) for p, i in new.items()], FILES), f"{root}/files", number)
    for p, i in new.items():
        if status[p] == "QUARANTINED" and quarantine:
            counts = files[place_of(p)].asDict()
            put_away(p, quarantine, i.hash, report=tables.error_report(stages.validated.filter(F.col("file") == counts["file"]), counts))
        elif status[p] == "COMPLETED" and archive:
            put_away(p, archive, i.hash)
    return out | status
