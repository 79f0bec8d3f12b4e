"""A folder of JSON Lines files as a stream of imports: each micro-batch is one commit of the stored tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeworks.config import Settings
from gaugeworks.plans import ingest
from gaugeworks.sources import tables
from gaugeworks.sources.jsonl import parse_lines


def stream_commit(checkpoint: str, number: int) -> str:
    """A commit's name: the same when a micro-batch is tried again, and another one for each stream."""
    return f"stream={hashlib.sha256(checkpoint.encode()).hexdigest()[:12]}={number}"


def import_stream(spark: SparkSession, folder: str, settings: Settings, root: str, ingest_us: int, checkpoint: str, files_at_once: int = 100) -> StreamingQuery:
    """Import what is in the folder and not yet imported, then stop. A micro-batch that is tried again is stored once."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", "*.json*").load(folder)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.trim("value").alias("line")).filter("line <> ''")

    def store(batch: DataFrame, number: int) -> None:
        place = F.col("block") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        with tables.commit(spark, root, stream_commit(checkpoint, number)) as under:
            if under is not None:
                stages = ingest.store(parse_lines(batch.withColumn("position", place)), settings, root, under, ingest_us)
                tables.write_batch(stages.files.select("file", "total", "accepted", "status"), f"{root}/stream_files", under)

    return lines.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
