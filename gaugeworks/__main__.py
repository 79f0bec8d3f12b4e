"""python -m gaugeworks --config FILE --store FOLDER COMMAND: imports and the fixed queries, as JSON lines."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.config import dimensions, load, local_table
from gaugeworks.functions.times import parse_admin_time
from gaugeworks.operators import rules, stored, windows
from gaugeworks.plans import ingest
from gaugeworks.sources import tables

RETAINED = ("samples", "intervals", "aggregates")
MERGED = {"samples": (ingest.SAMPLES, None), "intervals": (ingest.INTERVALS, None), "aggregates": (ingest.AGGREGATES, [*windows.KEY, "version"])}
AUDIT = "at_us long, operation string, actor string, target string, result string"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("gaugeworks", description=__doc__)
    out.add_argument("--config", required=True)
    out.add_argument("--store", required=True)
    sub = out.add_subparsers(dest="command", required=True)
    add = sub.add_parser("import")
    add.add_argument("paths", nargs="+")
    for name in ("--archive", "--quarantine"):
        add.add_argument(name)
    add.add_argument("--now", help="time of the import; the present without it")
    sub.add_parser("status")
    query = sub.add_parser("samples")
    query.add_argument("--device", required=True)
    query.add_argument("--metric", required=True)
    for name in ("--from", "--to"):
        query.add_argument(name)
    query.add_argument("--limit", type=int, default=1000)
    query.add_argument("--no-synthetic", action="store_true")
    devices = sub.add_parser("devices")
    devices.add_argument("--tag", action="append", default=[], help="key=value")
    alerts = sub.add_parser("incidents")
    alerts.add_argument("--state", choices=("open", "closed"))
    alerts.add_argument("--severity")
    sub.add_parser("history")
    windows_ = sub.add_parser("windows")
    windows_.add_argument("--all", action="store_true", help="superseded versions too")
    files = sub.add_parser("files")
    files.add_argument("--path", help="the newest entry of a path")
    files.add_argument("--status", action="append", default=[])
    ack = sub.add_parser("ack")
    ack.add_argument("uuid")
    ack.add_argument("--by", required=True)
    ack.add_argument("--comment", default="")
    keep = sub.add_parser("retain")
    keep.add_argument("--days", type=int, required=True)
    keep.add_argument("--table", action="append", choices=RETAINED, help="all of them without it")
    keep.add_argument("--now", help="time from which days count; the present without it")
    merge = sub.add_parser("compact", help="merge the files of days before the last N")
    merge.add_argument("--days", type=int, default=1)
    merge.add_argument("--now", help="time from which days count; the present without it")
    sub.add_parser("audit")
    sub.add_parser("check")
    return out


def _us(spark: SparkSession, text: str | None) -> int | None:
    if text is None:
        return None
    us = spark.range(1).select(parse_admin_time(F.lit(text)).alias("us")).first()["us"]
    if us is None:
        raise SystemExit(f"not a time: {text}")
    return us


def audit(spark: SparkSession, root: str, operation: str, target: str, result: str, actor: str = "cli") -> None:
    now = time.time_ns() // 1000
    with tables.commit(spark, root, f"audit={now}") as number:
        tables.write_batch(local_table(spark, [(now, operation, actor, target, result)], AUDIT), f"{root}/audit", number)


def acknowledge(spark: SparkSession, root: str, args: argparse.Namespace) -> DataFrame:
    """Store an acknowledgement of a known incident; its state stays."""
    known = rules.incidents(ingest.read_incidents(spark, root)).filter(F.col("incident_uuid") == args.uuid)
    if known.isEmpty():
        raise SystemExit(f"no incident {args.uuid}")
    now = time.time_ns() // 1000
    with tables.commit(spark, root, f"ack={now}") as number:
        tables.write_batch(local_table(spark, [(args.uuid, args.by, args.comment, now)], ingest.ACKS), f"{root}/acks", number)
    audit(spark, root, "ack", args.uuid, "ok", args.by)
    return stored.acknowledged(known, tables.read_table(spark, f"{root}/acks", ingest.ACKS))


def answer(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    settings, root = load(args.config), args.store
    samples = tables.read_table(spark, f"{root}/samples", ingest.SAMPLES)
    files = tables.read_table(spark, f"{root}/files", ingest.FILES)
    if args.command == "import":
        now = _us(spark, args.now) if args.now else time.time_ns() // 1000
        try:
            done = ingest.import_files(spark, sorted(args.paths), settings, root, now, args.archive, args.quarantine)
        except Exception as e:
            audit(spark, root, "import", ",".join(sorted(args.paths)), f"failed: {type(e).__name__}: {str(e)[:500]}")
            raise
        audit(spark, root, "import", ",".join(sorted(args.paths)), json.dumps(done, sort_keys=True))
        return spark.createDataFrame(sorted(done.items()), "path string, status string")
    if args.command == "retain":
        oldest = (_us(spark, args.now) if args.now else time.time_ns() // 1000) - args.days * 86_400_000_000
        gone = [(t, d) for t in args.table or RETAINED for d in tables.retain(spark, root, t, oldest)]
        audit(spark, root, "retain", ",".join(args.table or RETAINED), json.dumps(gone))
        return local_table(spark, gone, "table string, day string")
    if args.command == "compact":
        before = tables.day_of((_us(spark, args.now) if args.now else time.time_ns() // 1000) - args.days * 86_400_000_000)
        done = []
        for table, (schema, keys) in MERGED.items():
            days = [n[4:] for n in tables.names_in(spark, f"{root}/{table}") if n.startswith("day=") and n[4:] < before]
            done += [(table, d) for d in days if tables.compact(spark, root, table, schema, d, keys)]
        audit(spark, root, "compact", before, json.dumps(done))
        return local_table(spark, done, "table string, day string")
    if args.command == "status":
        return stored.status(files).unionByName(samples.agg(F.lit("SAMPLES").alias("status"), F.count("*").alias("files")))
    if args.command == "samples":
        return stored.query_samples(samples, args.device, args.metric, _us(spark, getattr(args, "from")), _us(spark, args.to), not args.no_synthetic, args.limit)
    if args.command == "devices":
        found = stored.devices_by_tag(dimensions(spark, settings)["devices"], **dict(t.split("=", 1) for t in args.tag))
        return found if args.tag else found.join(tables.read_snapshot(spark, f"{root}/devices", ingest.DEVICES), "device_id", "outer").orderBy("device_id")
    if args.command == "files":
        return stored.latest_file(files, args.path) if args.path else stored.files_in(files, *(args.status or ("COMPLETED", "QUARANTINED")))
    if args.command == "windows":
        found = ingest.read_aggregates(spark, root)
        return (found if args.all else windows.current(found)).orderBy(*windows.KEY, "version")
    if args.command == "ack":
        return acknowledge(spark, root, args)
    if args.command == "audit":
        return tables.read_table(spark, f"{root}/audit", AUDIT).orderBy("at_us")
    if args.command == "check":
        return stored.orphans(samples.select("device_id", "metric_id", "event_time_us"), dimensions(spark, settings)["devices"], "device_id")
    output = ingest.read_incidents(spark, root)
    acks = tables.read_table(spark, f"{root}/acks", ingest.ACKS)
    if args.command == "incidents":
        return stored.acknowledged(stored.query_incidents(rules.incidents(output), args.state, args.severity), acks).orderBy(F.desc("started_us"), "rule_id", "device_id")
    told = acks.select("incident_uuid", F.col("acked_us").alias("at_us"), F.lit(None).cast("string").alias("from_state"), F.lit(None).cast("string").alias("to_state"), F.lit("ACKNOWLEDGED").alias("reason"))
    return stored.query_history(rules.incident_history(output).unionByName(told), rules.incidents(output))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    for line in answer(spark, args).toJSON().toLocalIterator():
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
