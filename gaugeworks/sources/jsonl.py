"""JSON Lines: one object a line, strict types, unknown fields kept as ext_json. Lines split, so a file is many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions.text import sanitize
from gaugeworks.sources.records import MOST_BYTES, OPTIONAL, REQUIRED, place_in_file

DEPTH = 16
_INTEGER = r"^(BIGINT|DECIMAL\((19|[23][0-9]),0\))$"  # a decimal without places is 1.0, or too long for a long


def depth_of(text: Column) -> Column:
    """The deepest nesting of objects and arrays, strings apart."""
    marks = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', ""), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, c: Column) -> Column:
        now = F.when(c.isin("{", "["), s["now"] + 1).when(c.isin("}", "]"), F.greatest(s["now"] - 1, F.lit(0))).otherwise(s["now"])
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    many = F.length(F.regexp_replace(marks, r"[\]}]", "")) > DEPTH  # else it can't be too deep
    return F.when(many, F.aggregate(F.split(marks, ""), start, step, lambda s: s["most"])).otherwise(0)


def read_jsonl(spark: SparkSession, paths: list[str]) -> DataFrame:
    """RECORD rows of the files; lines that aren't records have parse_error."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), place_in_file().alias("position"), F.regexp_replace("value", r"^[ \t\r]+|[ \t\r]+$", "").alias("line"))
    return parse_lines(lines.filter("line <> ''"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """lines: file, position, line."""
    rows = lines.withColumn("j", F.try_parse_json("line"))
    sub = {n: F.try_variant_get("j", f"$.{n}", "variant") for n in (*REQUIRED, *OPTIONAL)}
    rows = rows.select("file", "position", "line", "j", F.schema_of_variant("j").alias("type"), *(v.alias(n) for n, v in sub.items()), *(F.schema_of_variant(v).alias(f"{n}_type") for n, v in sub.items()))
    kind = lambda n: F.col(f"{n}_type")
    text = lambda n: F.try_variant_get(F.col(n), "$", "string")
    number = r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$"
    value = F.try_variant_get(F.col("value"), "$", "double")
    sequence = F.try_variant_get(F.col("sequence"), "$", "decimal(38,0)")
    tags = F.from_json(F.to_json("tags"), "map<string,variant>")
    given = lambda n: kind(n).isNotNull() & (kind(n) != "VOID")
    error = F.when(F.octet_length("line") > MOST_BYTES, "line too long").when(depth_of(F.col("line")) > DEPTH, "nesting too deep").when(F.col("j").isNull(), "not JSON").when(~F.col("type").startswith("OBJECT"), "not an object")
    for n in ("device_id", "metric", "unit"):
        error = error.when(kind(n).isNull(), f"missing {n}").when(kind(n) != "STRING", f"{n} must be a string")
    error = (
        error.when(kind("event_time").isNull(), "missing event_time")
        .when(~kind("event_time").rlike("^STRING$|" + _INTEGER), "event_time must be a string or an integer")
        .when(kind("value").isNull(), "missing value")
        .when(~kind("value").rlike(number + "|^VOID$"), "value must be a number or null")
        .when(value.isNotNull() & (F.isnan(value) | (F.abs(value) == float("inf"))), "value must be finite")
        .when(given("quality") & ~kind("quality").rlike(_INTEGER), "quality must be an integer")
        .when(given("sequence") & (~kind("sequence").rlike(_INTEGER) | (sequence < 0) | (sequence > F.lit("18446744073709551615").cast("decimal(38,0)"))), "sequence must be unsigned")
        .when(given("tags") & ~kind("tags").startswith("OBJECT"), "tags must be an object")
        .when(given("tags") & F.exists(F.map_values(tags), lambda v: F.schema_of_variant(v) != "STRING"), "tag values must be strings")
    )
    rest = F.map_filter(F.from_json("line", "map<string,variant>"), lambda k, v: ~k.isin(*REQUIRED, *OPTIONAL))
    extra = F.when(F.col("type").startswith("OBJECT") & (F.size(rest) > 0), F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.transform_values(rest, lambda k, v: F.to_json(v)))))))
    return rows.select(
        text("device_id").alias("device_id"), text("metric").alias("metric"), text("event_time").alias("event_time"), kind("value").isNotNull().alias("has_value"), value.alias("value"), text("unit").alias("unit"),
        F.try_variant_get(F.col("quality"), "$", "int").alias("quality"), sequence.try_cast("decimal(20,0)").alias("sequence"), F.when(given("tags"), F.transform_values(tags, lambda k, v: F.try_variant_get(v, "$", "string"))).alias("tags"),
        extra.alias("ext_json"), "file", "position", sanitize(F.col("line")).alias("raw"), error.alias("parse_error"),
    )
