"""The Jaccard join against brute force on random families of near copies, hot groups and edge cases."""

import random
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from gaugeworks.llm import jaccard
from gaugeworks.llm.features import chunks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(FOLD))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if j < i and both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def corpus(seed):
    """Families whose members lie around the threshold, copies, shared passages, short texts."""
    r = random.Random(seed)
    word = lambda: r.choice("the of and to in".split()) if r.random() < 0.4 else f"w{r.randint(0, 3000)}"
    passage = " ".join(word() for _ in range(60))
    texts = []
    for _ in range(6):
        base = [word() for _ in range(r.choice([8, 40, 120, 300]))]
        for _ in range(r.choice([3, 12, 40])):
            mine = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                mine[r.randrange(len(mine))] = word()
            texts.append(" ".join(mine))
    texts += [" ".join(word() for _ in range(r.randint(0, 120))) + " " + passage for _ in range(30)] + [passage] * 5 + [passage.upper()] * 5
    texts += [" ".join(word() for _ in range(r.randint(0, 6))) for _ in range(40)] + [None, "", "one", "One", "two words"]
    r.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("seed,block", [(1, jaccard.BLOCK), (2, 2000), (3, 500)])
def test_groups(spark, documents, monkeypatch, seed, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = corpus(seed)
    found = jaccard.groups(documents(list(texts.values())))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute(texts)


def test_order_has_no_effect(spark, documents, monkeypatch):
    texts = corpus(4)
    monkeypatch.setattr(jaccard, "HEAVY", 4)
    monkeypatch.setattr(jaccard, "LOCAL", 1)
    found = jaccard.groups(documents(list(texts.values())))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute(texts)


def test_keep_one(spark, documents):
    texts = corpus(1)
    kept = jaccard.keep_one(documents(list(texts.values())))
    assert kept.columns == documents([]).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in brute(texts).items() if i == c)


def test_edge_cases(spark, edge, documents):
    from .conftest import EDGE

    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.groups(edge).collect()} == brute(dict(enumerate(EDGE)))
    assert jaccard.groups(edge.limit(0)).count() == 0
    ids = [7, 7, None, 3, 7]
    texts = ["a b c d e f g h", "a b c d e f g h", "a b c d e f g h", "p q r s t u v", "p q r s t u v"]
    rows = [(r.doc_id, r.component_id) for r in jaccard.groups(documents(texts, ids)).collect()]
    assert sorted(rows, key=str) == [(3, 3), (7, 3), (7, 3), (7, 3), (None, 3)]


def test_null_and_repeated_ids(spark, documents):
    """Rows without an id link others, also as the only holders of a text; each group keeps one row."""
    base = [f"w{i}" for i in range(60)]
    one, two, three = " ".join([f"x{i}" for i in range(7)] + base[7:]), " ".join(base), " ".join(base[:-7] + [f"y{i}" for i in range(7)])
    similar = lambda a, b: 100 * len(shingles(a) & shingles(b)) >= 75 * len(shingles(a) | shingles(b))
    assert similar(one, two) and similar(two, three) and not similar(one, three)
    texts = [one, two, two, three, "lone text without an id here", "lone text without an id here", "", None, "some other words that repeat here", "some other words that repeat here"]
    ids = [4, None, None, 9, None, None, None, None, 6, 6]
    frame = documents(texts, ids)
    found = jaccard.groups(frame).collect()
    assert sorted([(r.doc_id, r.component_id) for r in found], key=str) == sorted([(4, 4), (None, 4), (None, 4), (9, 4), (None, None), (None, None), (None, None), (None, None), (6, 6), (6, 6)], key=str)
    kept = jaccard.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == sorted([(4, one), (None, texts[4]), (None, ""), (None, None), (6, texts[8])], key=str)
    large = spark.createDataFrame([(1 << 62, "a b c d e f"), (None, "a b c d e f"), (None, "p q r s t u")], "doc_id long, text string")
    assert sorted([(r.doc_id, r.component_id) for r in jaccard.groups(large).collect()], key=str) == sorted([(1 << 62, 1 << 62), (None, 1 << 62), (None, None)], key=str)


@pytest.mark.parametrize("many", [2, 1 << 20])
def test_heavy_keys(spark, documents, monkeypatch, many):
    """Wherever the line between broadcast and joined keys lies, and with all lists hot."""
    monkeypatch.setattr(jaccard, "MANY", many)
    monkeypatch.setattr(jaccard, "LOCAL", 1)
    texts = corpus(5)
    texts |= {len(texts) + i: texts[0] for i in range(len(texts) // 2)}
    found = jaccard.groups(documents(list(texts.values())))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute(texts)


def test_long_text(spark, documents):
    """Texts above a megabyte, near copies of each other."""
    r = random.Random(9)
    words = [f"w{r.randrange(10**6)}" for _ in range(200_000)]
    texts = [" ".join(words), " ".join(words[:180_000]), " ".join(words[100_000:])]
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.groups(documents(texts)).collect()} == brute(dict(enumerate(texts)))


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 200), (200, 300), (100, 100)] + [(500, 500 + i) for i in range(1, 30)]
    found = {r.node: r.root for r in jaccard.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {200: 100, 300: 100} | {500 + i: 500 for i in range(1, 30)}


@pytest.mark.parametrize("few", [0, jaccard.FEW])
def test_components_by_either_way(spark, monkeypatch, few):
    """Few edges are joined without a checkpoint, and both ways agree on chains, repeated edges, loops and negative ids."""
    calls, settled = [], jaccard.settled
    monkeypatch.setattr(jaccard, "settled", lambda x: calls.append(1) or settled(x))
    monkeypatch.setattr(jaccard, "FEW", few)
    r = random.Random(6)
    edges = [(r.randint(-200, 200), r.randint(-200, 200)) for _ in range(150)] + [(1 << 61, (1 << 61) + i) for i in range(5)] + [(1000 + 7 * i % 50, 1000 + 7 * (i + 1) % 50) for i in range(50)]
    want = {n: n for e in edges for n in e}
    while any(want[x] != want[y] for x, y in edges):
        for x, y in edges:
            want[x] = want[y] = min(want[x], want[y])
    found = {x.node: x.root for x in jaccard.components(spark.createDataFrame(edges + edges, "x long, y long")).collect()}
    assert found == {n: root for n, root in want.items() if n != root}
    assert bool(calls) == (few == 0)
    assert jaccard.components(spark.createDataFrame([(3, 3)], "x long, y long")).collect() == []


def test_groups_of_many_links(spark, documents, monkeypatch):
    """With no table small enough for the driver or a broadcast, and rows of one id with several texts."""
    monkeypatch.setattr(jaccard, "FEW", 0)
    monkeypatch.setattr(jaccard, "BLOCK", 2000)
    texts = corpus(7)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.groups(documents(list(texts.values()))).collect()} == brute(texts)
    ids = [5, 5, 2, 9]
    found = jaccard.groups(documents(["a b c d e f g h", "p q r s t u v w", "p q r s t u v w", "a b c d e f g h"], ids)).collect()
    assert [(x.doc_id, x.component_id) for x in sorted(found)] == [(2, 2), (5, 2), (5, 2), (9, 2)]


def test_checkpoints_of_few_links(spark, documents, monkeypatch):
    """On tables of many partitions each checkpoint costs a stage of as many tasks, so small ones must need few of them."""
    calls, settled = [], jaccard.settled
    monkeypatch.setattr(jaccard, "settled", lambda x: calls.append(1) or settled(x))
    jaccard.groups(documents(list(corpus(1).values()))).collect()
    assert len(calls) <= 20


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_chunks_of_few_words(n):
    """Chunks that hold fewer words in all than a shingle, and some more."""
    common = np.ones(1 << jaccard.MARKS, np.int64)
    for count in range(8):
        for texts in ([" ".join(f"w{i}" for i in range(count))], [f"w{i}" for i in range(count)] or [""]):
            for chunk in chunks(pa.array(texts)):
                plain = list(jaccard.shingle_sets(chunk, n))
                found = list(jaccard.shingle_sets(chunk, n, common))
                assert len(plain) == len(found) == len(chunk)
                assert all(np.array_equal(a, b) and len(b) == len(level) for a, (b, level) in zip(plain, found, strict=True))
                if len(texts) == 1 and count >= n:
                    assert all((level == n).all() for _, level in found)


@pytest.mark.parametrize(("master", "collected"), [("local", 0), ("local[4]", 0), ("local[*, 3]", 0), ("local-cluster[3,2,3000]", 1), ("spark://host:7077", 1), ("yarn", 1)])
def test_garbage(monkeypatch, master, collected):
    """The driver's garbage, and with it old shuffles, goes wherever executors are processes of their own."""
    calls = []
    context = SimpleNamespace(master=master, _jvm=SimpleNamespace(System=SimpleNamespace(gc=lambda: calls.append(1))))
    frame = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context))
    monkeypatch.setattr(jaccard, "settled", lambda x: x)
    assert jaccard.shared(frame) is frame and len(calls) == collected


def test_last_rows(monkeypatch, documents):
    """The answers are settled, and garbage goes, before the result's rows are looked up."""
    events = []
    settled, tidied = jaccard.settled, jaccard.tidied
    monkeypatch.setattr(jaccard, "settled", lambda x: events.append(x.columns) or settled(x))
    monkeypatch.setattr(jaccard, "tidied", lambda x: events.append("tidied") or tidied(x))
    texts = ["a b c d e f", "a b c d e f", "other words than these here"]
    found = jaccard.groups(documents(texts))
    assert events[-3:] == ["tidied", ["n", "a", "b", "root", "copies"], "tidied"]
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in found.collect()} == brute(dict(enumerate(texts)))


def test_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    want = duckdb.sql(jaccard.oracle().replace("FROM documents", f"FROM '{folder}/documents.parquet'")).fetchall()
    assert {d: (n, c) for d, n, c in want} == brute({r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()})
