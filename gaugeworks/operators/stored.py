"""The fixed queries over stored tables, retention, and the rules by which rows enter them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.text import has_tags
from gaugeworks.operators.lateness import SYNTHETIC


def query_samples(samples: DataFrame, device: str, metric: str, from_us: int | None = None, to_us: int | None = None, synthetic: bool = True, limit: int = 1000) -> DataFrame:
    """The first `limit` samples of a series in [from, to), by time and arrival."""
    rows = samples.filter((F.col("device_id") == device) & (F.col("metric_id") == metric))
    rows = rows if from_us is None else rows.filter(F.col("event_time_us") >= from_us)
    rows = rows if to_us is None else rows.filter(F.col("event_time_us") < to_us)
    rows = rows if synthetic else rows.filter(F.col("flags").bitwiseAND(F.lit(SYNTHETIC)) == 0)
    return rows.orderBy("event_time_us", "arrival").limit(limit)


def query_incidents(incidents: DataFrame, state: str | None = None, severity: str | None = None, limit: int = 1000) -> DataFrame:
    """The newest `limit` incidents."""
    rows = incidents if state is None else incidents.filter(F.col("state") == state)
    rows = rows if severity is None else rows.filter(F.col("severity") == severity)
    return rows.orderBy(F.desc("started_us"), "rule_id", "device_id").limit(limit)


def query_history(history: DataFrame, incidents: DataFrame) -> DataFrame:
    return history.join(incidents.select("incident_uuid", "rule_id", "device_id", "severity"), "incident_uuid").orderBy("at_us", "incident_uuid")


def status(files: DataFrame) -> DataFrame:
    return files.groupBy("status").agg(F.count("*").alias("files"))


def devices_by_tag(devices: DataFrame, **tags: str) -> DataFrame:
    return devices.filter(has_tags(F.col("tags"), tags)).orderBy("device_id")


def orphans(child: DataFrame, parent: DataFrame, on: str) -> DataFrame:
    """Rows whose parent is missing."""
    return child.join(parent.select(on).distinct(), on, "left_anti")


def latest_file(files: DataFrame, path: str) -> DataFrame:
    return files.filter(F.col("path") == path).orderBy(F.desc("first_seen_us"), "hash").limit(1)


def files_in(files: DataFrame, *statuses: str) -> DataFrame:
    return files.filter(F.col("status").isin(*statuses)).orderBy("path")


def page(rows: DataFrame, after: int, size: int, by: str = "seq") -> DataFrame:
    """The next `size` rows after a key."""
    return rows.filter(F.col(by) > after).orderBy(by).limit(size)


def retain(rows: DataFrame, days: int, now_us: int, time: str = "event_time_us") -> DataFrame:
    return rows.filter(F.col(time) >= now_us - days * 86_400_000_000)


def insert_or_ignore(stored: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The new rows whose key isn't stored, one for each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    first = new.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    return first.join(stored.select(*key).distinct(), key, "left_anti").select(*new.columns)


def acknowledged(incidents: DataFrame, acks: DataFrame) -> DataFrame:
    """incidents with the newest acknowledgement of each. acks: incident_uuid, acked_by, ack_comment, acked_us."""
    newest = acks.groupBy("incident_uuid").agg(F.max_by(F.struct("acked_by", "ack_comment", "acked_us"), "acked_us").alias("a"))
    return incidents.join(newest, "incident_uuid", "left").select(*incidents.columns, "a.acked_by", "a.ack_comment", "a.acked_us")


def acknowledge(incidents: DataFrame, uuid: str, by: str, comment: str, at_us: int) -> DataFrame:
    """The incidents with an acknowledgement on one of them; its state stays."""
    mine = F.col("incident_uuid") == uuid
    old = {c: F.col(c) if c in incidents.columns else F.lit(None) for c in ("acked_by", "ack_comment", "acked_us")}
    return incidents.withColumns({"acked_by": F.when(mine, by).otherwise(old["acked_by"]), "ack_comment": F.when(mine, comment).otherwise(old["ack_comment"]), "acked_us": F.when(mine, F.lit(at_us)).otherwise(old["acked_us"].cast("bigint"))})


def disabled_devices(known: DataFrame, configured: DataFrame) -> DataFrame:
    """All known devices, enabled if they are configured."""
    rows = known.select("device_id").unionByName(configured.select("device_id")).distinct()
    return rows.join(configured.select("device_id", F.lit(True).alias("enabled")).distinct(), "device_id", "left").withColumn("enabled", F.coalesce("enabled", F.lit(False)))
