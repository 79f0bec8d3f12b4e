"""Event times as text: Unix milliseconds or ISO 8601, with an offset or in a device's zone, to UTC microseconds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMAT, BUSINESS = "format", "business"
_BODY = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9]{2}(?:\.[0-9]{1,6})?)"
_OFFSET = r"(Z|z|[+-][0-9]{2}:?[0-9]{2})\s*$"
_ISO = _BODY + r"(?:Z|z|[+-][0-9]{2}:?[0-9]{2})?\s*$"
MOST_MS = (2**63 - 1) // 1000


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def parse_event_time(raw: Column, zone: Column | None = None, earlier: bool = True) -> Column:
    """struct<us: bigint, leap: boolean, kind: string, error: string>; us is null exactly if there is an error.

    kind is `format` for text that isn't a time and `business` for times out of range, in a gap of daylight saving or
    with an impossible offset. A second of 60 is the next minute's first and sets leap. Without an offset the time is
    local to `zone` (a name column); without a zone it is a format error. Of an hour that a clock shows twice, the
    earlier or the later instant counts."""
    given = F.struct(
        raw.alias("raw"), (zone if zone is not None else F.lit(None).cast("string")).alias("zone"), raw.rlike(r"^-?[0-9]+$").alias("number"), raw.rlike(_ISO).alias("iso"),
        F.regexp_extract(raw, _BODY, 6).alias("seconds"), F.regexp_extract(raw, _OFFSET, 1).alias("offset"),
    )
    return _with(given, lambda x: _with(_read(x), lambda r: _with(_placed(r, earlier), _judged)))


def _read(x: Column) -> Column:
    """The parts of a time as numbers. The form is fixed, so all but the seconds and the offset stand in fixed places."""
    raw, offset = x["raw"], x["offset"]
    with_offset = x["iso"] & (offset != "")
    plain = F.regexp_replace(offset, "[:+-]", "")
    utc = F.lower(offset) == "z"
    # only text that is a number is cast: each that isn't costs an exception inside, more than all the rest
    hours, minutes = (F.when(with_offset & ~utc, F.substring(plain, at, 2).try_cast("int")) for at in (1, 3))
    sign = F.when(F.substring(offset, 1, 1) == "-", -1).otherwise(1)
    parts = [F.when(x["iso"], F.substring(raw, at, n).try_cast("int")) for at, n in ((1, 4), (6, 2), (9, 2), (12, 2), (15, 2))]
    leap = x["iso"] & x["seconds"].startswith("60")
    seconds = F.when(x["iso"], F.regexp_replace(x["seconds"], "^60", "00").try_cast("decimal(8,6)"))
    return F.struct(
        raw.alias("raw"), x["zone"].alias("zone"), x["number"].alias("number"), x["iso"].alias("iso"), with_offset.alias("with_offset"), leap.alias("leap"),
        F.when(x["number"] & (F.length(F.regexp_replace(raw, "^-", "")) <= 16), raw.try_cast("bigint")).alias("ms"), F.try_make_timestamp(*parts, seconds, F.lit("UTC")).alias("at"),
        F.when(utc, F.lit(0).cast("bigint")).otherwise(sign * (hours * 60 + minutes).cast("bigint") * 60_000_000).alias("offset_us"), (with_offset & ~utc & ((hours > 23) | (minutes > 59))).alias("offset_bad"),
    )


def _placed(r: Column, earlier: bool) -> Column:
    """The parts with the instant of a local time, and whether clocks skip it."""
    here = F.coalesce(r["zone"], F.lit("UTC"))

    def place(first: Column) -> Column:
        local = first
        if not earlier:
            for shift in (30, 60, 120):
                later = F.timestamp_micros(F.unix_micros(first) + shift * 60_000_000)
                local = F.when(F.from_utc_timestamp(later, here) == r["at"], later).otherwise(local)
        return F.struct(r.alias("r"), local.alias("local"), (F.from_utc_timestamp(first, here) != r["at"]).alias("gap"))

    return _with(F.to_utc_timestamp(r["at"], here), place)


def _judged(p: Column) -> Column:
    r = p["r"]
    ms_ok = F.coalesce((r["ms"] <= MOST_MS) & (r["ms"] >= -MOST_MS), F.lit(False))
    extra = F.when(r["leap"], F.lit(60_000_000)).otherwise(F.lit(0)).cast("bigint")
    us = F.when(r["number"], F.when(ms_ok, r["ms"] * 1000)).when(r["with_offset"], F.unix_micros(r["at"]) - r["offset_us"] + extra).when(r["iso"], F.unix_micros(p["local"]) + extra)
    error = (
        F.when(r["raw"].isNull() | (r["raw"] == ""), "empty time")
        .when(r["number"] & ~ms_ok, "unix milliseconds out of range")
        .when(r["number"], F.lit(None))
        .when(~r["iso"], "time is not a supported format")
        .when(r["offset_bad"], "UTC offset out of range")
        .when(r["at"].isNull(), "time is not a supported format")
        .when(r["with_offset"], F.lit(None))
        .when(r["zone"].isNull(), "time without offset requires a device timezone")
        .when(p["gap"], "local time does not exist (DST gap)")
    )
    kind = lambda e: F.when(e.isNull(), F.lit(None)).when(e.isin("unix milliseconds out of range", "UTC offset out of range", "local time does not exist (DST gap)"), BUSINESS).otherwise(FORMAT)
    found = F.struct(us.alias("us"), r["leap"].alias("leap"), error.alias("error"))
    return _with(found, lambda f: F.struct(F.when(f["error"].isNull(), f["us"]).alias("us"), F.when(f["error"].isNull(), f["leap"]).alias("leap"), kind(f["error"]).alias("kind"), f["error"].alias("error")))


def parse_admin_time(raw: Column) -> Column:
    """UTC microseconds of an operator's argument, where no offset means UTC; null if it isn't a time."""
    return parse_event_time(raw, F.lit("UTC"))["us"]


def format_utc_us(us: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SS.ffffffZ; the session's zone must be UTC."""
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
