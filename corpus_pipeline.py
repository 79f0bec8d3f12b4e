"""The corpus pipeline: five stages over documents, each written and read again.

quality rules (rejected documents go), n-gram Jaccard join (the document with the smallest id of each group stays),
benchmark decontamination (documents that leak a test item go), secret scans (secrets are blanked out, documents stay),
packing (one row for each piece of a document).

Defined cases, as the operators': null and empty texts fail the quality rules; rows without an id are documents of their own,
and one row of each group stays, repeated rows included; ties and very long texts as the operators say; an empty table passes
all stages with no rows; other columns, whatever their names, pass all stages but packing, which has columns of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import decontam, jaccard, packing, quality, secrets
from gaugeworks.llm.queries import table, tokenizer_path
from gaugeworks.llm.session import prepare
from gaugeworks.sources.scratch import remove, scratch

#: The classifier and the packing aren't SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents that the base rules and the classifier keep; without labels of both classes the classifier keeps all."""
    prepare(spark)
    return quality.filter_quality(docs, table(spark, folder, "documents"), table(spark, folder, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates; documents without words stay."""
    prepare(spark)
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents that leak no test item; without items all."""
    prepare(spark)
    return decontam.decontaminate(docs, table(spark, folder, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, with a mark in place of each secret, and n_chars of the new text; a null text keeps its n_chars."""
    found = secrets.redact(docs)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return found.select(*(F.col(f"`{c}`") for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """A row for each piece of each document and its place in a sequence; a null text is the end id alone."""
    prepare(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("secret scans", secret_scans), ("packing", packed)]


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The last stage's rows. The others' are written to the cluster's shared folder, and go when the next one's are there."""
    docs = table(spark, folder, "documents")
    place = scratch(spark, "corpus-pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, folder).write.parquet(f"{place}/{k}")
        docs = spark.read.parquet(f"{place}/{k}")
        if k:
            remove(spark, f"{place}/{k - 1}")
    return STAGES[-1][1](spark, docs, folder)
