"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over the hashed distinct words of a text and ascending thresholds give P(grade >= k) =
sigmoid(score - threshold_k); from these follow the expected grade and the tail probability by which texts are selected.
The fit uses at most `limit` labelled rows (training.FIT_ROWS), weighs the grades alike, keeps few weights (lasso) and runs in one task; every text
is scored whole, in Arrow batches, without a shuffle.

Defined cases: null grades don't count; a grade seen in no labelled text has no influence but keeps its threshold's
place; without two grades every text has the highest grade; null and empty texts score by the thresholds alone and are
never selected; very long texts are scored whole; of several ratings of one document the lowest counts; of grades alike in
probability the lowest is given; an empty table gives no rows; repeated rows each get their row; other columns pass through
grade_texts, but one of the output's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm import training as L

GRADES = 3
SELECT_AT = 0.25
RATE, STEPS, LASSO = 0.3, 100, 1e-3
GRADED = "expected_grade double, p_top double, grade int, selected boolean"


def tails(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k = 0 .. grades, one row for each score."""
    inner = L.sigmoid(score[:, None] - thresholds[None, :])
    return np.hstack([np.ones((len(score), 1)), inner, np.zeros((len(score), 1))])


def fit_ordinal(documents: DataFrame, ratings: DataFrame, grades: int = GRADES, limit: int = L.FIT_ROWS) -> np.ndarray:
    """Weights, then grades - 1 ascending thresholds; empty without two grades. documents: id, text; ratings: id, grade."""
    width = 1 << L.BITS

    def fit(rows: pd.DataFrame) -> np.ndarray:
        rows = rows[(rows["grade"] >= 0) & (rows["grade"] < grades)]
        y = rows["grade"].to_numpy(int)
        seen = np.bincount(y, minlength=grades)
        if (seen > 0).sum() < 2:
            return np.empty(0)
        data = L.Sparse(list(rows["slots"]), list(rows["weights"]), width)
        weight = 1 / (seen[y] * (seen > 0).sum())

        def thresholds(w: np.ndarray) -> np.ndarray:
            return w[width] + np.append(0, np.cumsum(np.exp(w[width + 1 :])))

        def gradient(w: np.ndarray) -> np.ndarray:
            cuts = thresholds(w)
            p = tails(data.times(w[:width]), cuts)
            at = np.arange(len(y))
            upper, lower = p[at, y], p[at, y + 1]
            likely = np.maximum(upper - lower, 1e-12)
            g = np.zeros(len(w))
            g[:width] = -data.back(weight * (1 - upper - lower))
            by_cut = np.zeros(grades - 1)
            np.add.at(by_cut, np.maximum(y - 1, 0), np.where(y > 0, weight * upper * (1 - upper) / likely, 0))
            np.add.at(by_cut, np.minimum(y, grades - 2), np.where(y < grades - 1, -weight * lower * (1 - lower) / likely, 0))
            g[width] = by_cut.sum()
            for k in range(1, grades - 1):
                g[width + k] = by_cut[k:].sum() * np.exp(w[width + k])
            return g

        w = L.adagrad(np.zeros(width + grades - 1), gradient, RATE, STEPS, LASSO, width)
        return np.append(w[:width], thresholds(w))

    return L.fit_in_one_task(L.labelled_vectors(documents, ratings, limit, L.word_vectors), fit)


def grade_texts(documents: DataFrame, model: np.ndarray, grades: int = GRADES, select_at: float = SELECT_AT, output: str = "graded") -> DataFrame:
    """documents and, in `output`, the struct GRADED; an input column of that name is replaced."""
    weights, cuts = model[: 1 << L.BITS].astype(np.float32), model[1 << L.BITS :]
    kept = [f for f in documents.schema.fields if f.name != output]
    schema = T.StructType([*kept, T.StructField(output, T._parse_datatype_string(GRADED))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            n = batch.num_rows
            p = tails(L.score_words(column, weights), cuts) if len(model) else np.tile([1.0] * grades + [0.0], (n, 1))
            each = p[:, :-1] - p[:, 1:]
            some = np.array([bool(x) for x in column.to_pylist()], bool)
            values = [pa.array(p[:, 1:-1].sum(1)), pa.array(p[:, grades - 1]), pa.array(each.argmax(1).astype(np.int32)), pa.array((p[:, grades - 1] >= select_at) & some)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.StructArray.from_arrays(values, [x.split()[0] for x in GRADED.split(", ")])], [*(f.name for f in kept), output])

    return documents.mapInArrow(run, schema)


def ratings_of(labels: DataFrame) -> DataFrame:
    """Grades from two flags: 0 toxic, 1 of low quality, 2 good."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select(F.col("doc_id").alias("id"), grade.alias("grade"))


def graded_rows(documents: DataFrame, labels: DataFrame, limit: int = L.FIT_ROWS, select_at: float = SELECT_AT) -> DataFrame:
    """One row for each document: doc_id and GRADED."""
    model = fit_ordinal(documents.select(F.col("doc_id").alias("id"), "text"), ratings_of(labels), GRADES, limit)
    return grade_texts(documents.select("doc_id", "text"), model, GRADES, select_at).select("doc_id", "graded.*")
