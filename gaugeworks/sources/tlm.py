"""The binary frame format: a checked header, then frames of typed fields with a checksum, optionally compressed.

A file is decoded in order, as a damaged frame makes all later records of the file suspicious, so a file is one task.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format.
MAGIC, HEADER, FRAME, SYNC = b"TLM1", 24, 16, b"\x5a\xa5"
MOST_PAYLOAD, MOST_SCAN, MOST_FIELDS, MOST_FIELD, MOST_TAGS = 4 << 20, 1 << 20, 256, 4096, 16
DEVICE, METRIC, TIME, VALUE, NULL, UNIT, QUALITY, SEQUENCE, TAGS = range(1, 10)
SIZES = {TIME: 8, VALUE: 8, NULL: 0, QUALITY: 1, SEQUENCE: 8}
NAME, UNIT_NAME = re.compile(rb"[A-Za-z0-9._-]{1,64}"), re.compile(rb"[\x21-\x7e]{1,32}")
_FIELD = struct.Struct("<BH")
#: Texts and tags that frames repeat are checked once, as long as they are among so many.
CACHED = 4096
ROWS = "device_id string, metric string, event_time string, has_value boolean, value double, unit string, quality int, sequence string, tags map<string,string>, position long, parse_error string, no_value boolean"


class FrameError(ValueError):
    """What is wrong with a header, frame or payload."""


@dataclass
class Reading:
    device_id: str
    metric: str
    event_time_ms: int
    value: float | None
    unit: str
    quality: int | None = None
    sequence: int | None = None
    tags: dict[str, str] = field(default_factory=dict)


def check_header(data: bytes) -> None:
    if len(data) < HEADER:
        raise FrameError("truncated header")
    if data[:4] != MAGIC:
        raise FrameError("bad magic")
    version, size, _, flags, crc = struct.unpack_from("<HHqII", data, 4)
    for wrong, what in ((zlib.crc32(data[:20]) != crc, "bad header checksum"), (size != HEADER, "bad header size"), (version != 1, "unsupported version"), (flags != 0, "bad header flags")):
        if wrong:
            raise FrameError(what)


@functools.lru_cache(CACHED)
def _text(raw: bytes, pattern: re.Pattern) -> str:
    if not pattern.fullmatch(raw):
        raise FrameError("bad field text")
    return raw.decode("ascii")


@functools.lru_cache(CACHED)
def _tags(raw: bytes) -> dict[str, str]:
    out, at, n = {}, 0, 0
    while at < len(raw):
        parts = []
        for low, high in ((1, 128), (0, 128)):
            if len(raw) - at < 2:
                raise FrameError("truncated tag")
            size = struct.unpack_from("<H", raw, at)[0]
            at += 2
            if not low <= size <= high or size > len(raw) - at:
                raise FrameError("bad tag size")
            parts.append(raw[at : at + size].decode("utf-8", "replace"))
            at += size
        n += 1
        if n > MOST_TAGS:
            raise FrameError("too many tags")
        out[parts[0]] = parts[1]
    return out


def decode_payload(raw: bytes) -> Reading:
    """A data frame's fields; unknown ones are skipped."""
    found: dict[int, bytes] = {}
    at = n = 0
    while at < len(raw):
        if len(raw) - at < 3:
            raise FrameError("truncated field")
        kind, size = _FIELD.unpack_from(raw, at)
        at += 3
        n += 1
        if size > len(raw) - at or n > MOST_FIELDS or size > MOST_FIELD:
            raise FrameError("bad field size")
        if DEVICE <= kind <= TAGS:
            if kind in found or (kind == VALUE and NULL in found) or (kind == NULL and VALUE in found):
                raise FrameError("repeated field")
            found[kind] = raw[at : at + size]
        at += size
    for kind, held in found.items():
        if len(held) != SIZES.get(kind, len(held)):
            raise FrameError("bad field size")
    if not (DEVICE in found and METRIC in found and TIME in found and UNIT in found and (VALUE in found or NULL in found)):
        raise FrameError("missing field")
    number = lambda k, form: struct.unpack(form, found[k])[0] if k in found else None
    return Reading(_text(found[DEVICE], NAME), _text(found[METRIC], NAME), number(TIME, "<q"), number(VALUE, "<d"), _text(found[UNIT], UNIT_NAME), number(QUALITY, "<B"), number(SEQUENCE, "<Q"), dict(_tags(found.get(TAGS, b""))))


def decode(data: bytes) -> Iterator[tuple[int, Reading | FrameError]]:
    """(position, reading or error) of each data frame. FrameError is raised for the file's header alone."""
    check_header(data)
    at, last, damaged = HEADER, 0, False
    while at < len(data):
        if data[at : at + 2] != SYNC:
            found = data.find(SYNC, at, at + MOST_SCAN + 2)
            if found < 0:
                yield at, FrameError("no frame found")
                return
            at, damaged = found, True
        if len(data) - at < FRAME:
            yield at, FrameError("truncated trailing frame")
            return
        kind, flags, size, sequence = struct.unpack_from("<BBIQ", data, at + 2)
        end = at + FRAME + size + 4
        try:
            if end > len(data) and size <= MOST_PAYLOAD:
                raise FrameError("truncated frame")
            if flags & 0xFE:
                raise FrameError("bad frame flags")
            if size > MOST_PAYLOAD:
                raise FrameError("payload too large")
            stored = data[at + FRAME : end - 4]
            if zlib.crc32(stored) != struct.unpack_from("<I", data, end - 4)[0]:
                raise FrameError("bad payload checksum")
            if sequence <= last:
                raise FrameError("sequence went back")
            last = sequence
            if kind == 1:
                reading = decode_payload(inflate(stored) if flags & 1 else stored)
                if damaged:
                    reading.quality = max(reading.quality or 0, 1)
                    reading.tags = {**reading.tags, "resync": "true"}
                yield at, reading
            at = end
        except FrameError as e:
            yield at, e
            if str(e) in ("sequence went back",) or (str(e) not in ("truncated frame", "bad frame flags", "payload too large", "bad payload checksum")):
                at = end  # the frame's own bounds are sound
            else:
                at, damaged = at + 2, True
                if data.find(SYNC, at, at + MOST_SCAN + 2) < 0:
                    return


def inflate(raw: bytes) -> bytes:
    try:
        stream = zlib.decompressobj()
        out = stream.decompress(raw, MOST_PAYLOAD)
    except zlib.error:
        raise FrameError("bad compression") from None
    if not stream.eof:
        raise FrameError("bad compression")
    return out


@functools.lru_cache(CACHED)
def _tag_bytes(pairs: tuple[tuple[str, str], ...]) -> bytes:
    return b"".join(struct.pack("<H", len(x.encode())) + x.encode() for pair in pairs for x in pair)


def encode(readings: list[Reading], created_at_ms: int = 0, compress: bool = False) -> bytes:
    """A file that holds the readings."""
    head = MAGIC + struct.pack("<HHqI", 1, HEADER, created_at_ms, 0)
    out = [head + struct.pack("<I", zlib.crc32(head))]
    for n, r in enumerate(readings, 1):
        tags = _tag_bytes(tuple(sorted(r.tags.items())))
        fields = [(DEVICE, r.device_id.encode()), (METRIC, r.metric.encode()), (TIME, struct.pack("<q", r.event_time_ms)), (NULL, b"") if r.value is None else (VALUE, struct.pack("<d", r.value)), (UNIT, r.unit.encode())]
        fields += ([(QUALITY, bytes([r.quality]))] if r.quality is not None else []) + ([(SEQUENCE, struct.pack("<Q", r.sequence))] if r.sequence is not None else []) + [(TAGS, tags)] * bool(tags)
        payload = b"".join([_FIELD.pack(k, len(v)) + v for k, v in fields])
        payload = zlib.compress(payload) if compress else payload
        out.append(SYNC + struct.pack("<BBIQ", 1, int(compress), len(payload), n) + payload + struct.pack("<I", zlib.crc32(payload)))
    return b"".join(out)


def read_tlm(spark: SparkSession, paths: list[str]) -> DataFrame:
    """RECORD rows of the files. A file with a bad header is one row with parse_error."""
    return decode_files(spark.read.format("binaryFile").load(paths).select("path", "content"))


def decode_files(contents: DataFrame) -> DataFrame:
    """RECORD rows of files given as path and content."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["file", *(x.split()[0] for x in ROWS.replace("map<string,string>", "m").split(", "))]
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                rows = []
                try:
                    for at, found in decode(bytes(content)):
                        if isinstance(found, FrameError):
                            rows.append((path, None, None, None, False, None, None, None, None, None, at, str(found), True))
                        else:
                            rows.append((path, found.device_id, found.metric, str(found.event_time_ms), True, found.value, found.unit, found.quality, None if found.sequence is None else str(found.sequence), found.tags, at, None, found.value is None))
                except FrameError as e:
                    rows.append((path, None, None, None, False, None, None, None, None, None, 0, f"header: {e}", True))
                out = pd.DataFrame(rows, columns=names, dtype=object)
                yield out.astype({"quality": "Int32", "position": "int64", "value": "float64"}) if len(out) else out

    found = contents.select("path", "content").mapInPandas(run, "file string, " + ROWS)
    value = F.when(~F.col("no_value"), F.coalesce("value", F.lit(float("nan"))))  # pandas has one mark for null and NaN
    return found.select("device_id", "metric", "event_time", "has_value", value.alias("value"), "unit", "quality", F.col("sequence").cast("decimal(20,0)").alias("sequence"), "tags", F.lit(None).cast("string").alias("ext_json"), "file", "position", F.lit(None).cast("string").alias("raw"), "parse_error")
