"""Small string, map and hash functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTIFIER = r"^[A-Za-z0-9._-]{1,64}\z"
UNIT = r"^[\x21-\x7E]{1,32}\z"
TAG_KEY = r"^[A-Za-z0-9._-]{1,128}\z"


def sanitize(raw: Column, most: int = 256) -> Column:
    """Without control characters, at most `most` characters."""
    return F.left(F.regexp_replace(raw, r"[\x00-\x1F\x7F]", ""), F.lit(most))


def sorted_tags(tags: Column) -> Column:
    """A map with its keys in order."""
    return F.map_from_entries(F.array_sort(F.map_entries(tags)))


def tags_json(tags: Column) -> Column:
    """A JSON object with sorted keys; null tags are an empty object."""
    return F.when(tags.isNull() | (F.size(tags) == 0), F.lit("{}")).otherwise(F.to_json(sorted_tags(tags)))


def json_tags(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


def tags_from_pairs(text: Column) -> Column:
    """Tags from k=v|k=v, the last of equal keys; null if the syntax is wrong."""
    pairs = F.transform(F.split(text, r"\|"), lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.substring(p, F.instr(p, "=") + 1, F.length(p)).alias("value")))
    last = F.filter(F.transform(pairs, lambda p, i: F.struct(p["key"].alias("key"), p["value"].alias("value"), i.alias("i"))), lambda p: p["i"] == F.array_max(F.transform(F.filter(F.transform(pairs, lambda q, j: F.struct(q["key"].alias("key"), j.alias("j"))), lambda q: q["key"] == p["key"]), lambda q: q["j"])))
    good = F.forall(F.split(text, r"\|"), lambda p: p.rlike("^[^=]+="))
    return F.when(text.isNull() | (text == ""), F.create_map().cast("map<string,string>")).when(good, F.map_from_entries(F.transform(last, lambda p: F.struct(p["key"], p["value"]))))


def with_tag(tags: Column, key: str, value: str) -> Column:
    """Tags with one more, which replaces one of its name."""
    rest = F.map_filter(F.coalesce(tags, F.create_map().cast("map<string,string>")), lambda k, v: k != key)
    return F.map_concat(rest, F.create_map(F.lit(key), F.lit(value)))


def has_tags(tags: Column, wanted: dict[str, str]) -> Column:
    """Whether all wanted pairs are there."""
    out = F.lit(True)
    for k, v in sorted(wanted.items()):
        out &= F.coalesce(F.element_at(tags, k) == v, F.lit(False))
    return out


def value_text(value: Column) -> Column:
    """`null`, or the value as a key on which -0 and 0 agree."""
    return F.when(value.isNull(), "null").otherwise(F.hex(F.xxhash64(value + F.lit(0.0))))
