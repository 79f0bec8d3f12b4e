"""The ordinal classifier: fit and scores against plain Python, held-out texts, edge cases."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from gaugeworks.llm import ordinal
from gaugeworks.llm import training as L
from gaugeworks.llm.features import buckets, chunks


def slot(word):
    ((slots, _),) = buckets(next(chunks(pa.array([word]))), L.BITS, (1,), ())
    return int(slots[0])


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def probabilities(score, cuts):
    """P(grade = k) for each k."""
    upper = [1.0, *(sigmoid(score - c) for c in cuts), 0.0]
    return [a - b for a, b in zip(upper, upper[1:], strict=False)]


def plain_fit(rows, grades=3):
    """The same descent with differences in place of derivatives. rows: words (distinct), grade."""
    words = sorted({w for ws, _ in rows for w in ws})
    seen = [sum(g == k for _, g in rows) for k in range(grades)]
    weight = [1 / (seen[g] * sum(x > 0 for x in seen)) for _, g in rows]
    place = {w: i for i, w in enumerate(words)}

    def cuts(w):
        out = [w[len(words)]]
        for step in w[len(words) + 1 :]:
            out.append(out[-1] + math.exp(step))
        return out

    def loss(w):
        return -sum(c * math.log(max(probabilities(sum(w[place[x]] for x in ws), cuts(w))[g], 1e-12)) for c, (ws, g) in zip(weight, rows, strict=True))

    w = [0.0] * (len(words) + grades - 1)
    total = [1e-8] * len(w)
    for _ in range(ordinal.STEPS):
        g = []
        for i in range(len(w)):
            up, down = list(w), list(w)
            up[i] += 1e-5
            down[i] -= 1e-5
            g.append((loss(up) - loss(down)) / 2e-5)
        for i in range(len(w)):
            total[i] += g[i] * g[i]
            w[i] -= ordinal.RATE * g[i] / math.sqrt(total[i])
            if i < len(words):
                w[i] = math.copysign(max(abs(w[i]) - ordinal.RATE * ordinal.LASSO / math.sqrt(total[i]), 0), w[i])
    return {x: w[i] for x, i in place.items()}, cuts(w)


def texts(seed=1, n=30):
    r = random.Random(seed)
    by = {0: ["awful", "the"], 1: ["dull", "the", "fine"], 2: ["fine", "great", "the"]}
    return [(i, " ".join(r.choices(by[i % 3], k=r.randint(2, 5))), i % 3) for i in range(n)]


@pytest.fixture(scope="module")
def fitted(spark):
    rows = spark.createDataFrame(texts(), "id long, text string, grade int")
    return ordinal.fit_ordinal(rows.select("id", "text"), rows.select("id", "grade"))


def test_fit_against_plain_python(fitted):
    weights, cuts = plain_fit([(sorted(set(t.split())), g) for _, t, g in texts()])
    assert fitted[1 << L.BITS :] == pytest.approx(cuts, abs=2e-3) and cuts[0] < cuts[1]
    for word, w in weights.items():
        assert fitted[slot(word)] == pytest.approx(w, abs=2e-3), word
    assert np.count_nonzero(fitted[: 1 << L.BITS]) <= len(weights)


def test_scores_against_plain_python(spark, documents, fitted):
    given = ["the fine great fine", "AWFUL the", "dull", "unseen words", "", None, "great " * 300_000 + "awful", "great", "great"]
    cuts = fitted[1 << L.BITS :]
    out = ordinal.grade_texts(documents(given), fitted)
    assert out.columns == [*documents([]).columns, "graded"] and ordinal.grade_texts(out, fitted).columns == out.columns
    found = {r.doc_id: r.graded for r in out.collect()}
    for i, text in enumerate(given):
        p = probabilities(sum(float(np.float32(fitted[slot(w)])) for w in {x.lower() for x in (text or "").split()}), cuts)
        assert found[i].expected_grade == pytest.approx(p[1] + 2 * p[2], abs=1e-6) and found[i].p_top == pytest.approx(p[2], abs=1e-6)
        assert found[i].grade == p.index(max(p)) and found[i].selected == (bool(text) and p[2] >= ordinal.SELECT_AT)


def test_held_out(spark):
    """Two thirds of the labels fit, the others judge: good rows are selected, others are not."""
    folder = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = ordinal.graded_rows(documents, labels.filter("doc_id % 3 <> 0")).join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    good, bad = ([r.selected for r in found if (r.quality == 1 and r.toxic == 0) is side] for side in (True, False))
    assert len(good) > 30 and len(bad) > 10 and sum(good) > 0.85 * len(good) and sum(bad) < 0.25 * len(bad)


def test_edge_cases(spark, edge):
    assert ordinal.graded_rows(edge, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 9
    one = ordinal.graded_rows(edge, spark.createDataFrame([(3, 1, 0), (None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")).collect()
    assert {r.doc_id: r.selected for r in one} == {i: i > 1 for i in range(9)} and {r.grade for r in one} == {2}
    assert ordinal.graded_rows(edge.limit(0), spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")).count() == 0
