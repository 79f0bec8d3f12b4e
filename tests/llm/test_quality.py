"""The quality rules and the ordinal classifier, against plain Python and on held-out rows."""

import re
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeworks.llm import ordinal, quality

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    count = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if count[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), again, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\t#|é漢\x0b\x1c ", max_size=60)), max_size=8))
def test_statistics(texts):
    found = quality.base_statistics(pa.array(texts, pa.string()))
    assert list(zip(*(found[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True)) == [statistics(t) for t in texts]


def tables(spark, folder=FOLDER):
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_rows(spark):
    documents, labels = tables(spark)
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = quality.quality_rows(documents, labels).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == statistics(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)


def test_held_out(spark):
    """Fit on half of some 4,000 labels; the other half is judged."""
    documents, labels = tables(spark, "/root/testdata/sf0.1")
    fit, held = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    judged = quality.quality_rows(documents, fit).withColumnRenamed("quality", "p").join(held, "doc_id").filter("not base_failed").collect()
    assert all(r.kept == (r.p >= quality.THRESHOLD) for r in judged)
    assert sum(r.kept == bool(r.quality) for r in judged) / len(judged) > 0.97
    assert sum(r.p for r in judged) / len(judged) == pytest.approx(sum(r.quality for r in judged) / len(judged), abs=0.05)  # calibrated
    graded = ordinal.graded_rows(documents, fit).join(held, "doc_id").collect()
    good = [r.selected for r in graded if r.quality == 1 and r.toxic == 0]
    bad = [r.selected for r in graded if r.toxic == 1 or r.quality == 0]
    assert sum(good) / len(good) > 0.9 and sum(bad) / len(bad) < 0.1
    by = {k: [r.expected_grade for r in graded if (0 if r.toxic else 1 + r.quality) == k] for k in range(3)}
    means = [sum(x) / len(x) for x in by.values()]
    assert means[0] < means[1] < means[2]


def test_edge_cases(spark, edge):
    labels = spark.createDataFrame([(5, 1, 0), (8, 0, 1), (None, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    assert quality.quality_rows(edge, labels).count() == 9 and ordinal.graded_rows(edge, labels).count() == 9
    kept = quality.filter_quality(edge, edge, none)
    assert kept.columns == edge.columns and kept.count() == 0
    assert quality.quality_rows(edge.limit(0), none).count() == 0 and ordinal.graded_rows(edge.limit(0), none).count() == 0
    assert not any(r.selected for r in ordinal.graded_rows(edge, labels).filter("doc_id < 2").collect())


def test_tails():
    import numpy as np

    p = ordinal.tails(np.array([0.0, 2.0]), np.array([-1.0, 1.0]))
    assert (np.diff(p, axis=1) <= 0).all() and p[1, 1] > p[0, 1] and p[0, 1] == pytest.approx(1 - p[0, 2])
