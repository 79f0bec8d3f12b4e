"""Bounded labelled samples and their hashed n-gram features, for the classifiers.

The sample is the LIMIT rows of the labels with the smallest hash of their id (a documented bound, FIT_ROWS), so it is
the same on every run. Features are made where the texts are; one task gets the sample's features and fits, and the
driver receives the fitted weights alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.features import buckets, chunks

FIT_ROWS = 3000
BITS = 16
FEATURES = "id long, grade int, fold int, slots binary, weights binary"


def text_vectors(column: pa.Array, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text: its buckets and values; each kind of n-gram has weight 1 in all."""
    for chunk in chunks(column):
        grams = buckets(chunk, bits)
        keys = []
        for kind, (slot, text) in enumerate(grams):
            key, count = np.unique(text * (len(grams) << bits) + (kind << bits) + slot, return_counts=True)
            owner = key // (len(grams) << bits)
            total = np.maximum(np.bincount(owner, count, len(chunk)), 1)
            keys.append((owner, key % (len(grams) << bits), np.sqrt(count / total[owner])))
        owner, slot, value = (np.concatenate(x) for x in zip(*keys, strict=True))
        order = np.argsort(owner, kind="stable")
        edges = np.searchsorted(owner[order], np.arange(len(chunk) + 1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            pick = order[a:b]
            yield slot[pick].astype(np.int32), value[pick].astype(np.float32)


def score_texts(column: pa.Array, weights: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The linear score of each text, by the features of text_vectors."""
    out = []
    for chunk in chunks(column):
        grams = buckets(chunk, bits)
        score = np.zeros(len(chunk))
        for kind, (slot, text) in enumerate(grams):
            key, count = np.unique(text * (1 << bits) + slot, return_counts=True)
            owner = key >> bits
            total = np.maximum(np.bincount(owner, count, len(chunk)), 1)
            score += np.bincount(owner, weights[(key & ((1 << bits) - 1)) + (kind << bits)] * np.sqrt(count / total[owner]), len(chunk))
        out.append(score)
    return np.concatenate(out) if out else np.empty(0)


def word_vectors(column: pa.Array, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text: the buckets of its distinct lower-cased words, each with value 1."""
    for chunk in chunks(column):
        ((slot, text),) = buckets(chunk, bits, (1,), ())
        key = np.unique((text << bits) + slot)
        edges = np.searchsorted(key, np.arange(len(chunk) + 1) << bits)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield (key[a:b] & ((1 << bits) - 1)).astype(np.int32), np.ones(b - a, np.float32)


def score_words(column: pa.Array, weights: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The linear score of each text, by the features of word_vectors."""
    out = []
    for chunk in chunks(column):
        ((slot, text),) = buckets(chunk, bits, (1,), ())
        key = np.unique((text << bits) + slot)
        out.append(np.bincount(key >> bits, weights[key & ((1 << bits) - 1)], len(chunk)))
    return np.concatenate(out) if out else np.empty(0)


def labelled_vectors(documents: DataFrame, grades: DataFrame, limit: int = FIT_ROWS, vectors: Callable[[pa.Array], Iterator[tuple[np.ndarray, np.ndarray]]] = text_vectors) -> DataFrame:
    """Features of the sample. grades: id, grade (null grades don't count); documents: id, text."""
    sample = grades.filter("id is not null and grade is not null").groupBy("id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("id"), "id").limit(limit)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, grade = batch.column("id"), batch.column("grade")
            pairs = list(vectors(batch.column("text")))
            fold = [int(x) * 2654435761 % 1000 * 5 // 1000 for x in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, grade.cast(pa.int32()), pa.array(fold, pa.int32()), pa.array([p[0].tobytes() for p in pairs], pa.binary()), pa.array([p[1].tobytes() for p in pairs], pa.binary())], ["id", "grade", "fold", "slots", "weights"])

    joined = documents.filter("text is not null").join(F.broadcast(sample), "id")
    return joined.select(F.col("id").cast("long").alias("id"), "grade", "text").mapInArrow(make, FEATURES)


class Sparse:
    """Rows of features as one list of entries."""

    def __init__(self, slots: list[bytes], weights: list[bytes], width: int):
        self.rows, self.width = len(slots), width
        self.counts = np.array([len(x) // 4 for x in slots], np.int64)
        self.slot, self.value = np.frombuffer(b"".join(slots), np.int32), np.frombuffer(b"".join(weights), np.float32)
        self.full = np.flatnonzero(self.counts)
        self.starts = (np.cumsum(self.counts) - self.counts)[self.full]

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.rows)
        if len(self.full):
            out[self.full] = np.add.reduceat(w[self.slot] * self.value, self.starts)
        return out

    def back(self, errors: np.ndarray) -> np.ndarray:
        return np.bincount(self.slot, np.repeat(errors, self.counts) * self.value, self.width)


def fit_in_one_task(vectors: DataFrame, fit: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
    """fit gets the bounded sample in id order; its vector of doubles comes to the driver."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [x for x in frames if len(x)]
        rows = pd.concat(found) if found else pd.DataFrame({"id": [], "grade": [], "fold": [], "slots": [], "weights": []})
        rows = rows.sort_values("id", kind="stable").drop_duplicates("id").reset_index(drop=True)
        yield pd.DataFrame({"model": [fit(rows).astype(np.float64).tobytes()]})

    return np.frombuffer(vectors.repartition(1).mapInPandas(run, "model binary").first()["model"], np.float64)


def adagrad(start: np.ndarray, gradient: Callable[[np.ndarray], np.ndarray], rate: float, steps: int, lasso: float = 0.0, width: int = 0) -> np.ndarray:
    """lasso: the price of the first `width` weights' absolute values, paid by shrinking them after each step."""
    w, total = start.copy(), np.full(len(start), 1e-8)
    for _ in range(steps):
        g = gradient(w)
        total += g * g
        w -= rate * g / np.sqrt(total)
        if lasso:
            w[:width] = np.sign(w[:width]) * np.maximum(np.abs(w[:width]) - rate * lasso / np.sqrt(total[:width]), 0)
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
