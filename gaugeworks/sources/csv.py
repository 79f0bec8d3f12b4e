"""CSV files: quoted fields, doubled quotes, embedded line breaks, comments, blank lines, byte order mark, , or ;.

A file is cut at its lines, so it is read in many tasks, whatever its size. Whether a range of a file begins inside a quoted field
depends on all quotes before it: a first pass finds, for each range, how it ends if it begins outside and if it begins inside, its
bytes, and the pieces of records that reach over its edges. The states and byte offsets of the beginnings follow by a running composition over
the ranges (a row for each), and a second pass cuts the records. Pieces are put together from the first pass.

A record that is longer than MOST_BYTES, whose quotes stay open at the end of the file, or that has too few or too many fields, comes as a row with
parse_error, as does a cell of a wrong type; of a record that is too long no more is kept than its beginning. A file without a usable
header is one row whose parse_error begins with `header: `; a file without any line gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.config import local_table
from gaugeworks.functions.text import sanitize, tags_from_pairs
from gaugeworks.shipping import ship
from gaugeworks.sources.records import MOST_BYTES, OPTIONAL, RECORD, REQUIRED
from gaugeworks.sources.scratch import settled

KEPT = 1024
BOM = b"\xef\xbb\xbf"
RANGES = "file string, block long, bytes long, header binary, header_at long, " + ", ".join(f"ends{s} int, head{s} binary, head_size{s} long, tail{s} binary, tail_size{s} long, tail_at{s} long" for s in (0, 1))


class HeaderError(ValueError):
    """A file without a usable header."""


def sniff(line: str) -> str:
    """; if it stands more often than , outside of quotes."""
    counts, quoted = {",": 0, ";": 0}, False
    for c in line:
        if c == '"':
            quoted = not quoted
        elif not quoted and c in counts:
            counts[c] += 1
    return ";" if counts[";"] > counts[","] else ","


def header_of(line: str) -> tuple[str, tuple[str, ...]]:
    """Delimiter and column names; HeaderError if a required one is missing or one comes twice."""
    line = line.removeprefix("﻿").rstrip("\r")
    sep = sniff(line)
    names = tuple(x.strip().strip('"') for x in line.split(sep))
    if missing := [x for x in REQUIRED if x not in names]:
        raise HeaderError(f"missing column {missing[0]}")
    if len(set(names)) != len(names):
        raise HeaderError("a column comes twice")
    return sep, names


class Piece:
    """The lines of one record so far; beyond MOST_BYTES only their number of bytes and the beginning."""

    def __init__(self, at: int | None):
        self.at, self.lines, self.size, self.first = at, [], -1, b""

    def add(self, line: bytes, size: int) -> None:
        if not self.lines and self.size < 0:
            self.first = line[:KEPT]
        self.size += size + 1
        if self.size <= MOST_BYTES:
            self.lines.append(line)
        else:
            self.lines = []

    def text(self) -> bytes:
        return b"\n".join(self.lines) if self.size <= MOST_BYTES else self.first


class Cutter:
    """Cuts a range into records. inside: whether it begins in a quoted field. Offsets count from the range's first line."""

    def __init__(self, inside: bool):
        self.open = Piece(None) if inside else None
        self.head: Piece | None = None  # what closes a record of an earlier range

    def feed(self, lines: pa.Array, sizes: np.ndarray, odd: np.ndarray, comment: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[Piece]]:
        """The numbers of the lines that are records by themselves, and the records of several lines that end here."""
        turns = odd.copy()
        inside = self.open is not None
        for i in np.flatnonzero(odd & comment):  # quotes in a comment count inside a quoted field alone
            turns[i] = inside ^ bool(turns[:i].sum() & 1)
        before = (inside + np.cumsum(turns) - turns) & 1
        ended: list[Piece] = []
        at = 0
        for edge in np.flatnonzero(turns).tolist():
            if self.open is None:
                self.open, at = Piece(int(offsets[edge])), edge
                continue
            self._take(lines, sizes, at, edge + 1)
            if self.open.at is None:
                self.head = self.open
            else:
                ended.append(self.open)
            self.open = None
        if self.open is not None:
            self._take(lines, sizes, at, len(turns))
        return np.flatnonzero((before == 0) & (turns == 0)), ended

    def _take(self, lines: pa.Array, sizes: np.ndarray, start: int, stop: int) -> None:
        for i in range(start, stop):
            self.open.add(lines[i].as_py(), int(sizes[i]))


class Range:
    """One range of a file, as its lines come."""

    def __init__(self, file: str, block: int, cutters: tuple[Cutter, ...]):
        self.file, self.block, self.cutters, self.bytes, self.header, self.header_at = file, block, cutters, 0, None, None

    def columns(self, batch: pa.RecordBatch) -> tuple:
        """lines, sizes, odd, comment, offsets, blank."""
        lines, sizes, odd = batch.column("line"), batch.column("size").to_numpy(), batch.column("odd").to_numpy(zero_copy_only=False)
        if self.block == 0 and self.bytes == 0 and lines[0].as_py().startswith(BOM):
            lines = pa.concat_arrays([pa.array([lines[0].as_py()[3:]], pa.binary()), lines.slice(1)])
        comment = pc.starts_with(lines, b"#").to_numpy(zero_copy_only=False)
        blank = pc.is_in(lines, pa.array([b"", b"\r"], pa.binary())).to_numpy(zero_copy_only=False)
        offsets = self.bytes + np.cumsum(sizes + 1) - (sizes + 1)
        self.bytes += int((sizes + 1).sum())
        return lines, sizes, odd, comment, offsets, blank


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, cut where the range changes."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        differs = [pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False) for c in (batch.column("block"), batch.column("file"))]
        cuts = [0, *(np.flatnonzero(differs[0] | differs[1]) + 1).tolist(), n]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of RANGES for each range."""
    names = [x.split()[0] for x in RANGES.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in RANGES.split(", ")]

    def told(r: Range) -> pa.RecordBatch:
        row = [r.file, r.block, r.bytes, r.header, r.header_at]
        for c in r.cutters:
            head = c.head or (c.open if c.open and c.open.at is None else None)  # still open: it goes through
            tail = c.open if c.open and c.open.at is not None else None
            row += [int(c.open is not None), head and head.text(), head and head.size, tail and tail.text(), tail and tail.size, tail and tail.at]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

    now: Range | None = None
    for run in runs(batches):
        file, block = run.column("file")[0].as_py(), run.column("block")[0].as_py()
        if now is None or (now.file, now.block) != (file, block):
            if now:
                yield told(now)
            now = Range(file, block, (Cutter(False), Cutter(True)))
        lines, sizes, odd, comment, offsets, blank = now.columns(run)
        useful = np.flatnonzero(~(comment | blank))
        if now.header is None and len(useful):
            now.header, now.header_at = lines[int(useful[0])].as_py(), int(offsets[useful[0]])
        for c in now.cutters:
            c.feed(lines, sizes, odd, comment, offsets)
    if now:
        yield told(now)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, position, size, record of the records that lie in one range."""
    now: Range | None = None
    for run in runs(batches):
        file, block = run.column("file")[0].as_py(), run.column("block")[0].as_py()
        if now is None or (now.file, now.block) != (file, block):
            now = Range(file, block, (Cutter(bool(run.column("start")[0].as_py())),))
        first = run.column("offset")[0].as_py()
        lines, sizes, odd, comment, offsets, blank = now.columns(run)
        single, ended = now.cutters[0].feed(lines, sizes, odd, comment, offsets)
        single = single[~(comment | blank)[single]]
        yield pa.RecordBatch.from_arrays([pa.array([file] * len(single), pa.string()), pa.array(offsets[single] + first), pa.array(sizes[single], pa.int64()), lines.take(pa.array(single))], ["file", "position", "size", "record"])
        if ended:
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(ended), pa.string()), pa.array([p.at + first for p in ended]), pa.array([p.size for p in ended]), pa.array([p.text() for p in ended], pa.binary())], ["file", "position", "size", "record"])


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, block (first byte of the range), size, odd (an odd number of quotes), line. Long lines lose their ends."""
    size, odd = F.octet_length("value").cast("long"), (F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    line = F.when(size > MOST_BYTES, F.left("value", F.lit(KEPT))).otherwise(F.col("value")).cast("binary")
    return spark.read.text(paths, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), size.alias("size"), odd.alias("odd"), line.alias("line"))


def survey(spark: SparkSession, paths: list[str]) -> DataFrame:
    """RANGES with offset (of the range's first line in the file) and start (1 in a quoted field)."""
    found = settled(_lines(spark, paths).mapInArrow(_survey, RANGES))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    until = Window.partitionBy("file").orderBy("block")
    # a range leaves the state, turns it, or sets it; after the last that sets it, turns are counted
    found = found.withColumn("turns", F.sum(F.when((F.col("ends0") == 1) & (F.col("ends1") == 0), 1).otherwise(0)).over(until))
    fixed = F.last(F.when(F.col("ends0") == F.col("ends1"), F.struct("ends0", "turns")), ignorenulls=True).over(earlier)
    found = found.withColumns({"offset": F.coalesce(F.sum("bytes").over(earlier), F.lit(0)), "fixed": fixed, "before": F.coalesce(F.max("turns").over(earlier), F.lit(0))})
    start = F.pmod(F.coalesce("fixed.ends0", F.lit(0)) + F.col("before") - F.coalesce("fixed.turns", F.lit(0)), F.lit(2))
    return found.withColumn("start", start.cast("int")).drop("turns", "fixed", "before")


def joined(ranges: DataFrame) -> DataFrame:
    """file, position, size, record, closed of the records that reach over an edge of a range."""
    s = lambda name: F.when(F.col("start") == 1, F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    piece = lambda kind, at: F.struct(F.lit(kind).alias("kind"), s(f"{at}_size").alias("size"), s(at).cast("string").alias("text"), (s("tail_at") + F.col("offset") if kind else F.lit(None).cast("long")).alias("position"), ((s("ends") == 0) | s("tail_at").isNotNull() if kind == 0 else F.lit(False)).alias("closes"))
    pieces = ranges.select("file", "block", F.explode(F.array(piece(0, "head"), piece(1, "tail"))).alias("p")).filter("p.size is not null")
    numbered = pieces.withColumn("number", F.sum("p.kind").over(Window.partitionBy("file").orderBy("block", "p.kind")))
    kept = F.when(F.col("p.size") <= MOST_BYTES, F.col("p.text")).otherwise(F.left("p.text", F.lit(KEPT)))
    each = numbered.groupBy("file", "number").agg(
        F.max("p.position").alias("position"), F.sum(F.col("p.size") + 1).alias("total"), F.max("p.closes").alias("closed"),
        F.array_sort(F.collect_list(F.struct("block", "p.kind", kept.alias("text")))).alias("parts"),
    )
    record = F.array_join(F.transform("parts", lambda p: p["text"]), "\n")
    return each.select("file", "position", (F.col("total") - 1).alias("size"), record.alias("record"), "closed")


def read_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """RECORD rows of the files."""
    ship(spark)
    ranges = survey(spark, paths)
    top = ranges.filter("header is not null").groupBy("file").agg(F.min_by(F.struct(F.col("header").cast("string").alias("line"), (F.col("offset") + F.col("header_at")).alias("at")), "block").alias("h"))
    groups: dict[tuple[str, tuple[str, ...]], list[tuple[str, int]]] = {}
    bad: list[tuple[str, str]] = []
    for r in top.select("file", "h.line", "h.at").collect():
        try:
            groups.setdefault(header_of(r["line"]), []).append((r["file"], r["at"]))
        except HeaderError as e:
            bad.append((r["file"], f"header: {e}"))
    out = local_table(spark, [(None,) * 10 + (f, 0, None, e) for f, e in sorted(bad)], RECORD)
    if not groups:
        return out
    # a row for each range (128 MB of the files, as Spark cuts them), so broadcast; a shuffle would lose the lines' order
    places = F.broadcast(ranges.select("file", "block", "offset", "start"))
    whole = _lines(spark, paths).join(places, ["file", "block"]).mapInArrow(_cut, "file string, position long, size long, record binary")
    records = whole.withColumns({"record": F.col("record").cast("string"), "closed": F.lit(True)}).unionByName(joined(ranges))
    return reduce(DataFrame.unionByName, (_group(spark, records, files, sep, names) for (sep, names), files in sorted(groups.items())), out)


def _group(spark: SparkSession, records: DataFrame, files: list[tuple[str, int]], sep: str, names: tuple[str, ...]) -> DataFrame:
    """The records of the files with one header. files: with the header's place, which is no record."""
    known = local_table(spark, [(f, at) for f, at in files], "file string, header long")
    rows = records.join(F.broadcast(known), "file").filter(F.col("position") > F.col("header"))
    columns = [f"c{i}" for i in range(len(names))]
    schema = ", ".join(f"{c} string" for c in [*columns, "corrupt"])
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt", "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1"}
    whole = F.regexp_replace("record", "\r$", "")
    rows = rows.withColumn("record", whole).withColumn("long", F.col("size") > MOST_BYTES)
    rows = rows.withColumn("r", F.from_csv(F.when(F.col("closed") & ~F.col("long"), F.col("record")), schema, options))
    at = {n: F.col(f"r.c{i}") for i, n in enumerate(names)}
    cell = lambda n: F.nullif(at[n], F.lit("")) if n in at else F.lit(None).cast("string")
    value, quality, sequence, tags = cell("value"), cell("quality"), cell("sequence"), cell("tags")
    number = F.trim(value).try_cast("double")
    error: Column = (
        F.when(~F.col("closed"), "unterminated quote")
        .when(F.col("long"), "record too long")
        .when(F.col("r.corrupt").isNotNull(), "column count")
        .when(value.isNotNull() & number.isNull(), "value is not a number")
        .when(quality.isNotNull() & ~F.coalesce(quality.rlike("^[0-9]{1,9}$"), F.lit(False)), "quality is not an integer")
        .when(sequence.isNotNull() & ~F.coalesce(sequence.rlike("^[0-9]{1,20}$") & (sequence.try_cast("decimal(20,0)") <= F.lit("18446744073709551615").cast("decimal(20,0)")), F.lit(False)), "sequence is not unsigned")
        .when(tags.isNotNull() & tags_from_pairs(tags).isNull(), "bad tags")
    )
    return rows.select(
        *(F.coalesce(cell(n), F.lit("")).alias(n) for n in ("device_id", "metric", "event_time")), F.lit(True).alias("has_value"), number.alias("value"), F.coalesce(cell("unit"), F.lit("")).alias("unit"),
        quality.try_cast("int").alias("quality"), sequence.try_cast("decimal(20,0)").alias("sequence"), tags_from_pairs(tags).alias("tags"), F.lit(None).cast("string").alias("ext_json"),
        "file", "position", sanitize(F.col("record")).alias("raw"), error.alias("parse_error"),
    )


def unknown_columns(names: tuple[str, ...]) -> list[str]:
    """Columns of a header that are warned of and ignored."""
    return [n for n in names if n not in (*REQUIRED, *OPTIONAL)]
