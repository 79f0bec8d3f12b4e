"""Stored tables: Parquet folders below one root, by day and commit, and a log that says which commits count.

All that an import writes, to however many tables, has its commit's number; readers take the numbers up to the latest one in
the log. The log's entry is one file made at the end, so a crash leaves the old state: what it wrote has a number that no reader
takes, and the next commit, which finds the mark of the one begun, removes it. A store has one writer at a time.

Days come first in the folders, so that a reader of some days lists and reads these alone. Tables of state (snapshots) are written whole by each
commit that changes them, and only the newest is read.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.sources.scratch import remove

LOG = "log"
#: Entries of the log that are kept, to know a commit again that is tried once more.
KEEP = 10_000


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, in whatever store it is; none if it isn't there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in system.listStatus(place)) if system.exists(place) else []


def _touch(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, False).close()


def commits(spark: SparkSession, root: str) -> dict[int, str]:
    """Name by number."""
    found = (re.fullmatch(r"(\d{12})-(.*)\.done", n) for n in names_in(spark, f"{root}/{LOG}"))
    return {int(m[1]): m[2] for m in found if m}


def latest(spark: SparkSession, root: str) -> int:
    return max(commits(spark, root), default=0)


@contextmanager
def commit(spark: SparkSession, root: str, name: str) -> Iterator[int | None]:
    """The number to write under; all of it counts when the block ends, none if it raises. None if the name is committed already."""
    done, name = commits(spark, root), quote(name, safe="=")
    if name in done.values():
        yield None
        return
    number = max(done, default=0) + 1
    begun = f"{root}/{LOG}/{number:012}.begun"
    if f"{number:012}.begun" in names_in(spark, f"{root}/{LOG}"):
        _sweep(spark, root, number)
    else:
        _touch(spark, begun)
    yield number
    _touch(spark, f"{root}/{LOG}/{number:012}-{name}.done")
    remove(spark, begun)
    for old, entry in done.items():
        if old <= number - KEEP:
            remove(spark, f"{root}/{LOG}/{old:012}-{entry}.done")


def _sweep(spark: SparkSession, root: str, number: int) -> None:
    """Remove what a commit that never ended has written."""
    for table in names_in(spark, root):
        if table != LOG:
            for folder in (f"{root}/{table}", *(f"{root}/{table}/{day}" for day in names_in(spark, f"{root}/{table}") if day.startswith("day="))):
                remove(spark, f"{folder}/number={number}")


def floor_of(spark: SparkSession, root: str, table: str) -> str:
    """The oldest day of a table that is kept; empty if all are."""
    mark = f"retain={table}="
    return max((n.removeprefix(mark) for n in commits(spark, root).values() if n.startswith(mark)), default="")


def merged_days(spark: SparkSession, root: str, table: str) -> dict[str, int]:
    """The days of a table that have been merged, with the number under which all that was there lies since."""
    mark = f"compact={table}="
    return {n.removeprefix(mark)[:10]: k for k, n in sorted(commits(spark, root).items()) if n.startswith(mark)}


def day_of(us: int) -> str:
    return (datetime.date(1970, 1, 1) + datetime.timedelta(days=us // 86_400_000_000)).isoformat()


def read_table(spark: SparkSession, path: str, schema: str, days: tuple[int, int] | list[str] | None = None, number: int | None = None, numbered: bool = False) -> DataFrame:
    """The stored rows; empty if there are none yet. numbered: with `written`, the commit's number.

    days: from and to in microseconds, or the days themselves; only their folders are listed and read. number: an own commit that hasn't ended, to be read as well."""
    root, table = path.rsplit("/", 1)
    upto, floor = number or latest(spark, root), floor_of(spark, root, table)
    folders = [n for n in names_in(spark, path) if n.startswith("day=") and not (floor and n[4:] < floor)]
    if isinstance(days, list):
        folders = [n for n in folders if n[4:] in set(days)]
    elif days is not None:
        folders = [n for n in folders if day_of(days[0]) <= n[4:] <= day_of(days[1])]
    merged = merged_days(spark, root, table)
    # where the folders from before a merge haven't gone yet, they don't count
    folders = [f for n in folders for f in ([n] if n[4:] not in merged else [f"{n}/{x}" for x in names_in(spark, f"{path}/{n}") if x.startswith("number=") and int(x[7:]) >= merged[n[4:]]])]
    if not folders:
        return spark.createDataFrame([], schema + (", written long" if numbered else ""))
    found = spark.read.schema(f"{schema}, day date, number long").option("basePath", path).parquet(*(f"{path}/{n}" for n in folders)).filter(F.col("number") <= upto)
    return found.withColumnRenamed("number", "written").drop("day") if numbered else found.drop("day", "number")


def read_batch(spark: SparkSession, path: str, schema: str, number: int) -> DataFrame:
    """The rows of one commit; its folders alone are read. Empty if there are none."""
    folders = [f"{path}/{n}/number={number}" for n in names_in(spark, path) if n.startswith("day=") and f"number={number}" in names_in(spark, f"{path}/{n}")]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, day date, number long").option("basePath", path).parquet(*folders).drop("day", "number")


def write_batch(rows: DataFrame, path: str, number: int, time: str | None = None) -> None:
    """Write rows of a commit, by the day of `time`; a day's rows are brought together, else each task writes a file for each day."""
    day = F.to_date(F.timestamp_micros(F.col(time))) if time else F.lit(None).cast("date")
    rows = rows.withColumns({"day": day, "number": F.lit(number).cast("long")})
    if time:
        rows = rows.hint("rebalance", "day")  # days of more than the advisory size are split
    rows.write.mode("append").partitionBy("day", "number").parquet(path)


def read_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest committed rows of a table of state."""
    upto = latest(spark, path.rsplit("/", 1)[0])
    numbers = [n for x in names_in(spark, path) if x.startswith("number=") and (n := int(x[7:])) <= upto]
    return spark.read.schema(schema).parquet(f"{path}/number={max(numbers)}") if numbers else spark.createDataFrame([], schema)


def write_snapshot(rows: DataFrame, path: str, number: int) -> None:
    """Write a table of state whole; all but the two newest go."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}/number={number}")
    for old in sorted(int(x[7:]) for x in names_in(spark, path) if x.startswith("number="))[:-2]:
        remove(spark, f"{path}/number={old}")


def retain(spark: SparkSession, root: str, table: str, oldest_us: int) -> list[str]:
    """Drop the days of a table before that of oldest_us: whole folders, unread. One commit hides them all; then they are deleted."""
    day = day_of(oldest_us)
    gone = [n for n in names_in(spark, f"{root}/{table}") if n.startswith("day=") and n[4:] < day]
    if gone:
        with commit(spark, root, f"retain={table}={day}"):
            pass
        for n in gone:
            remove(spark, f"{root}/{table}/{n}")
    return [n[4:] for n in gone]


def compact(spark: SparkSession, root: str, table: str, schema: str, day: str, keys: list[str] | None = None, rows_in_file: int = 2_000_000) -> bool:
    """Merge what commits have written for a day into few files, as one commit. keys: of rows equal in them the newest stays."""
    path = f"{root}/{table}"
    before = [x for x in names_in(spark, f"{path}/day={day}") if x.startswith("number=") and int(x[7:]) <= latest(spark, root)]
    if len(before) < 2:
        return False
    rows = read_table(spark, path, schema, [day], numbered=True)
    if keys:
        newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("written")))
        rows = rows.withColumn("__n", newest).filter("__n = 1").drop("__n")
    rows = rows.drop("written")
    with commit(spark, root, f"compact={table}={day}={latest(spark, root)}") as number:
        rows.repartition(rows.count() // rows_in_file + 1).write.parquet(f"{path}/day={day}/number={number}")
    for x in before:
        remove(spark, f"{path}/day={day}/{x}")
    return True


def error_report(validated: DataFrame, counts: dict, most: int = 100) -> dict:
    """A file's counts and at most `most` of its errors, by position."""
    rows = validated.filter("error is not null").orderBy("position").limit(most).select("position", "error.kind", "error.code", "raw").collect()
    return {**counts, "errors": [r.asDict() for r in rows]}
