"""The registered queries of the text operators: whole tables, production parameters."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import chat, decontam, extract, interaction, jaccard, ordinal, packing, pieces, pii, quality, repair, secrets, urls
from gaugeworks.llm.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(f)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        prepare(spark)
        return f(spark, folder)

    QUERIES[f.__name__] = run
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics and verdict of every document."""
    found = quality.quality_rows(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.withColumn("quality", F.round("quality", 6))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document and its place."""
    return packing.pack(table(spark, folder, "documents"), tokenizer_path())


@query
def op7_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    """Secret spans of every document."""
    return secrets.secret_rows(table(spark, folder, "documents"))


ORACLES["op7_secret_scans"] = secrets.oracle()


#: The contract's rules, word for word.
URL_RULES = (urls.Rule("block", "com", "/en/"), urls.Rule("allow", "example.com", "/en/7"), urls.Rule("allow", "net", "/de/"), urls.Rule("block", "example.net", "/de/8"), urls.Rule("block", "org", "/es/"))


@query
def op2_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    found = urls.judge_urls(table(spark, folder, "pages").select("page_id", "url"), URL_RULES)
    return found.select("row.page_id", "host", "path", "rule", "verdict", F.round("p_reject", 6).alias("p_reject"))


@query
def op10_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    found = extract.extract(table(spark, folder, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op5_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document and benchmark item that it leaks."""
    found = decontam.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.withColumns({c: F.round(c, 6) for c in ("score", "question_overlap", "answer_overlap")})


@query
def op9_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Size and group of every document's shingle set."""
    return jaccard.groups(table(spark, folder, "documents"))


ORACLES["op9_ngram_jaccard_join"] = jaccard.oracle()


@query
def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Expected grade, tail probability and selection of every document."""
    found = ordinal.graded_rows(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.withColumns({c: F.round(c, 6) for c in ("expected_grade", "p_top")})


@query
def op4_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """Prompt and masked completions of every conversation and its corrupted form."""
    return chat.preference_pairs(chat.corrupted_pairs(table(spark, folder, "conversations")))


ORACLES["op4_chat_formatting"] = chat.oracle()


@query
def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its personal data replaced, and the number of mentions."""
    found = pii.pseudonymize(table(spark, folder, "documents").select("doc_id", "text"), "registered-query", "n_entities")
    return found.select("doc_id", "text", "n_entities")


@query
def op11_filter_interaction_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Every order and step of the five filters, by language."""
    return interaction.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


ORACLES["op11_filter_interaction_audit"] = interaction.oracle()


def pieces_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op13_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Number and digest of every document's ids, and digest of the text that they decode to."""
    return pieces.digests(table(spark, folder, "documents"), pieces_path())


@query
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired turns of every conversation, after damage."""
    return repair.repair(repair.damage(table(spark, folder, "conversations")), "dropped")


ORACLES["op12_conversation_repair"] = repair.oracle()
