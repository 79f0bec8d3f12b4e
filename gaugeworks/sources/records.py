"""The one record that every input format becomes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RECORD = "device_id string, metric string, event_time string, has_value boolean, value double, unit string, quality int, sequence decimal(20,0), tags map<string,string>, ext_json string, file string, position long, raw string, parse_error string"
# The fields of the input formats.
REQUIRED = ("device_id", "metric", "event_time", "value", "unit")
OPTIONAL = ("quality", "sequence", "tags")
MOST_BYTES = 1 << 20


def place_in_file() -> Column:
    """A number that rises with a row's place in its file: the split's first byte and the row's number in the task.

    A file's whole splits are read by tasks of their own, where numbers start at 0 and stay below the split's length."""
    return F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))


def format_of(path: str) -> str | None:
    """csv, jsonl or tlm by the extension, a trailing .ready apart."""
    name = path.lower().removesuffix(".ready")
    return next((f for end, f in ((".csv", "csv"), (".jsonl", "jsonl"), (".json", "jsonl"), (".tlm", "tlm")) if name.endswith(end)), None)
