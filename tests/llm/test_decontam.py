"""Decontamination: block-max WAND against scoring everything, planted leaks, clean documents."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from gaugeworks.llm import decontam
from gaugeworks.llm.features import PUNCTUATION, chunks

R = random.Random(5)
VOCABULARY = [f"w{i}" for i in range(400)]
ITEMS = [(i, " ".join(R.choices(VOCABULARY, k=R.randint(8, 60)))) for i in range(60)]


def brute(items, passage):
    """BM25 of each item for the passage's distinct words, over the item's own total."""
    docs = [t.split() for _, t in items]
    held, mean = Counter(w for d in docs for w in set(d)), sum(map(len, docs)) / len(docs)
    out = {}
    for (i, _), d in zip(items, docs, strict=True):
        weight = {w: math.log(1 + (len(docs) - held[w] + 0.5) / (held[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(d) / mean)) for w, c in Counter(d).items()}
        out[i] = sum(x for w, x in weight.items() if w in passage) / sum(weight.values())
    return out


def test_retrieval_is_exact():
    index = decontam.build_index(ITEMS)
    texts = [" ".join(R.choices(VOCABULARY, k=R.randint(1, 500))) for _ in range(40)] + [f"{VOCABULARY[0]} {t}" for _, t in ITEMS[:20]]
    for chunk in chunks(pa.array(texts)):
        words = chunk.words(between=PUNCTUATION)
        got = {(t, a - words.edges[t], int(index.items[e])): s for t, a, _, e, s in decontam.retrieve(index, words, 0.4)}
        want = {}
        for t, text in enumerate(texts):
            w = text.split()
            for a in range(0, max(1, len(w) - decontam.WINDOW + decontam.STRIDE), decontam.STRIDE):
                want |= {(t, a, i): s for i, s in brute(ITEMS, set(w[a : a + decontam.WINDOW])).items() if s >= 0.4}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got) and len(got) > 20


def test_leaks(spark, documents):
    filler = lambda n: " ".join(R.choices([f"f{i}" for i in range(500)], k=n))
    texts = [None, "", filler(300)]
    texts += [f"{filler(R.randint(0, 200))} {t.upper() if k % 3 == 0 else t + '!'} {filler(R.randint(0, 200))}" for k, (_, t) in enumerate(ITEMS)]
    benchmark = spark.createDataFrame([*ITEMS, (98, None), (None, "x y z"), (99, "")], "item_id long, text string")
    found = decontam.leaks(documents(texts), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(k + 3, i) for k, (i, _) in enumerate(ITEMS)}
    clean = decontam.decontaminate(documents(texts), benchmark)
    assert clean.columns == documents(texts).columns and sorted(r.doc_id for r in clean.collect()) == [0, 1, 2]


def test_slices(spark, documents, monkeypatch):
    monkeypatch.setattr(decontam, "SLICE", 10)
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontam.leaks(documents([t for _, t in ITEMS]), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, i) for i, _ in ITEMS}
    assert decontam.decontaminate(documents([t for _, t in ITEMS]), benchmark).count() == 0


def test_half_a_leak(spark, documents):
    """The question without the answer isn't a leak, nor the answer alone."""
    item = [f"q{i}" for i in range(30)] + [f"a{i}" for i in range(10)]
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    texts = [" ".join(item[:30]) + " z" * 40, " ".join(item[30:]), " ".join(item)]
    assert [r.doc_id for r in decontam.leaks(documents(texts), benchmark).collect()] == [2]


def test_edge_cases(spark, edge):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "two words"), (2, "two words")], "item_id long, text string")
    assert decontam.leaks(edge, none).count() == 0 and decontam.decontaminate(edge, none).count() == 9
    assert sorted((r.doc_id, r.item_id) for r in decontam.leaks(edge, some).collect()) == [(4, 1), (4, 2)]
    assert decontam.leaks(edge.limit(0), some).count() == 0
    assert np.array_equal(decontam.grams(np.array([], np.uint64), 3), np.array([], np.uint64))


def test_runs_of_long_items(spark, documents):
    """A run of an item is found wherever it begins: the item's half question and half answer, or an entry's words."""
    item = [f"i{k}" for k in range(128)]
    filler = lambda n: " ".join(R.choices([f"f{k}" for k in range(500)], k=n))
    run = lambda item, a, b: f"{filler(R.randint(0, 150))} {' '.join(item[a:b])} {filler(R.randint(0, 150))}"
    for n in (97, decontam.ENTRY):
        texts = [run(item, a, a + n) for a in range(len(item) - n + 1)]
        benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
        assert sorted(r.doc_id for r in decontam.leaks(documents(texts), benchmark).collect()) == list(range(len(texts)))
        assert decontam.decontaminate(documents(texts), benchmark).count() == 0
    # of 72 words: question words 25 to 53 and answer words 54 to 63
    benchmark = spark.createDataFrame([(1, " ".join(item[:72]))], "item_id long, text string")
    texts = [run(item, 25, 64), run(item, 54, 72), run(item, 0, 30), filler(200)]
    assert [r.doc_id for r in decontam.leaks(documents(texts), benchmark).collect()] == [0]


def test_slices_change_nothing(spark, documents, monkeypatch):
    """The scores, and which partial leaks are found, don't depend on the number of slices."""
    r = random.Random(9)
    items = [(i, t) for i, t in ITEMS] + [(100 + i, " ".join(r.choices(VOCABULARY[:60], k=150))) for i in range(3)] + [(200, ""), (201, "?")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    texts = [" ".join(w for w in t.split() if r.random() < 0.8) for _, t in items] + [" ".join(t.split()[len(t.split()) // 3 :]) for _, t in items]
    found = []
    for size in (decontam.SLICE, 20, 7):
        monkeypatch.setattr(decontam, "SLICE", size)
        found.append(sorted((x.doc_id, x.item_id, x.passage, round(x.score, 9)) for x in decontam.leaks(documents(texts), benchmark).collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) > 10


def test_repeated_ids(spark, documents, monkeypatch):
    """Several texts of one item give one row for a document, whatever the slices."""
    r = random.Random(4)
    texts = [" ".join(r.choices(VOCABULARY, k=40)) for _ in range(24)]
    benchmark = spark.createDataFrame([(k // 2, t) for k, t in enumerate(texts)] + [(0, texts[0])], "item_id long, text string")
    leaking = [f"{texts[2 * k]} and {' '.join(r.choices(VOCABULARY, k=200))} {texts[2 * k + 1]}" for k in range(6)]
    found = []
    for size in (50_000, 20, 3):
        monkeypatch.setattr(decontam, "SLICE", size)
        found.append(sorted((x.doc_id, x.item_id, x.passage, round(x.score, 9)) for x in decontam.leaks(documents(leaking), benchmark).collect()))
    assert found[0] == found[1] == found[2] and [x[:2] for x in found[0]] == [(k, k) for k in range(6)]
