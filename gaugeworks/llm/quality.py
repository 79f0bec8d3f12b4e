"""Quality rules: base statistics of every text and a calibrated hashed n-gram logistic regression.

Words are runs of characters other than space and 0x09-0x0D. The classifier reads hashed 1- and 2-word and 4-character
n-grams of the whole text; its probability is calibrated by Platt's method on a held-out fifth of the sample. A text
stays when the base rules pass and the probability of good quality is at least THRESHOLD.

Defined cases: a null or empty text has no words, so n_words is 0 and it fails; very long texts are read whole; without
labels of both classes, and with an empty table of labels, the classifier keeps everything; of several labels of one document
the lowest counts; a probability of exactly THRESHOLD stays; an empty table gives no rows; repeated rows each get their row;
other columns of the input pass through filter_quality untouched, also those named like a statistic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm import features as X
from gaugeworks.llm import training as L

THRESHOLD = 0.35
MIN_WORDS = 50
MAX_REPEAT = 50
SYMBOLS = "#*$%&|<>"
STATISTICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"


def base_statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out: dict[str, list[np.ndarray]] = {k: [np.empty(0, np.int64)] for k in names}
    symbol = np.zeros(256, bool)
    symbol[[ord(c) for c in SYMBOLS]] = True
    for chunk in X.chunks(column):
        words = chunk.words()
        text = words.text
        out["n_words"].append(words.counts)
        out["word_chars"].append(chunk.per_text(((chunk.data & 0xC0) != 0x80) & ~X.SPACE[chunk.data]))
        out["n_symbols"].append(chunk.per_text(symbol[chunk.data]))
        owner, lines = chunk.lines()
        distinct = np.unique(X.keyed(lines, owner), return_index=True)[1]
        out["n_dup_lines"].append(np.bincount(owner, minlength=len(chunk)) - np.bincount(owner[distinct], minlength=len(chunk)))
        covered = np.zeros(len(text) + 2, bool)
        if len(text) >= 3:
            inside = text[:-2] == text[2:]
            grams, owner = words.grams(3)
            twice = np.zeros(len(text), bool)
            twice[np.flatnonzero(inside)] = X.repeated(X.keyed(grams, owner))
            for k in range(3):
                covered[k : k + len(text)] |= twice
        out["n_repeat_words"].append(np.bincount(text[covered[: len(text)]], minlength=len(chunk)))
    return {k: np.concatenate(v).astype(np.int64) for k, v in out.items()}


def fit_quality(documents: DataFrame, labels: DataFrame, limit: int = L.FIT_ROWS) -> np.ndarray:
    """Weights, then intercept and the two numbers of the calibration. Empty when a class is missing.

    documents: id, text; labels: id, grade (1 good, 0 bad). At most `limit` labelled rows are used."""
    width = 3 << L.BITS

    def fit(rows: pd.DataFrame) -> np.ndarray:
        y = rows["grade"].to_numpy(float)
        if len(rows) < 4 or y.min() == y.max():
            return np.empty(0)
        held = (rows["fold"] == 0).to_numpy()
        if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
            held[:] = False
        train, mine = rows[~held], y[~held]
        data = L.Sparse(list(train["slots"]), list(train["weights"]), width)
        balance = np.where(mine > 0, 0.5 / mine.mean(), 0.5 / (1 - mine.mean())) / len(mine)

        def gradient(w: np.ndarray) -> np.ndarray:
            e = (L.sigmoid(data.times(w[:-1]) + w[-1]) - mine) * balance
            return np.append(data.back(e) + 1e-6 * w[:-1], e.sum())

        w = L.adagrad(np.zeros(width + 1), gradient, 0.3, 60)
        test, truth = (rows[held], y[held]) if held.any() else (train, mine)
        z = L.Sparse(list(test["slots"]), list(test["weights"]), width).times(w[:-1]) + w[-1]
        goal = np.where(truth > 0, ((truth > 0).sum() + 1) / ((truth > 0).sum() + 2), 1 / ((truth == 0).sum() + 2))

        def calibrate(p: np.ndarray) -> np.ndarray:
            e = L.sigmoid(p[0] * z + p[1]) - goal
            return np.array([(e * z).mean(), e.mean()])

        return np.concatenate([w, L.adagrad(np.array([1.0, 0.0]), calibrate, 0.5, 300)])

    return L.fit_in_one_task(L.labelled_vectors(documents, labels, limit), fit)


def assess(documents: DataFrame, model: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """documents, with the struct column `assessed` of STATISTICS; texts stay as they are."""
    weights = model[: 3 << L.BITS].astype(np.float32)
    intercept, slope, shift = model[3 << L.BITS :] if len(model) else (0.0, 0.0, 0.0)
    name = "assessed"
    while name in documents.columns:
        name += "_"
    schema = T.StructType([*documents.schema.fields, T.StructField(name, T._parse_datatype_string(STATISTICS))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            base = base_statistics(column)
            failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT * base["n_words"])
            good = L.sigmoid(slope * (L.score_texts(column, weights) + intercept) + shift) if len(model) else np.ones(len(column))
            values = [pa.array(base["n_words"]), *(pa.array(base[k]) for k in ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(good), pa.array(~failed & (good >= threshold))]
            names = [x.split()[0] for x in STATISTICS.split(", ")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(values, names)], [*batch.schema.names, name])

    return documents.mapInArrow(run, schema)


def quality_rows(documents: DataFrame, labels: DataFrame, limit: int = L.FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: doc_id and STATISTICS."""
    model = fit_quality(*_training(documents, labels), limit)
    return assess(documents.select("doc_id", "text"), model, threshold).select("doc_id", "assessed.*")


def filter_quality(documents: DataFrame, texts: DataFrame, labels: DataFrame, limit: int = L.FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that stay, with their columns. texts: the documents the labels speak of."""
    found = assess(documents, fit_quality(*_training(texts, labels), limit), threshold)
    return found.filter(F.col(f"{found.columns[-1]}.kept")).select(*documents.columns)


def _training(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    return documents.select(F.col("doc_id").alias("id"), "text"), labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("grade"))
