"""Filter interaction audit against applying every order in plain Python, and against its SQL."""

import itertools
import re

import duckdb
import pytest

from gaugeworks.llm import interaction

LABELS = "doc_id long, quality int, toxic int, part string"


def brute(docs, labels):
    """docs: (doc_id, text, lang)."""
    good, toxic = ({d for d, *v in labels if d is not None and v[i] == 1} for i in (0, 1))
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    rows = []
    for d, t, lang in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > first[t]}
        rows.append((lang or "", {f for f, x in fails.items() if x}, d in good, d in toxic))
    out = set()
    for part in {r[0] for r in rows}:
        mine, sums, steps = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                sums[f] += len(gone)
                steps.append((part, order, step, len(left), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone), f))
        out |= {(*s[:-1], sums[s[-1]]) for s in steps}
    return out


def made():
    long = " ".join(f"w{i}" for i in range(220))
    texts = [None, "", " \t\n", "one two", "ONE TWO", "a # b", long, long + " $", long.upper(), "same " * 300, "same words " * 300 + "|", "é漢字 🙂 ß\x0b\x85\xa0A", "A", "big " * 400_000]
    docs = [(i, t, ("en", "de", None, "")[i % 4]) for i, t in enumerate(texts * 3)]
    docs += [(None, long, "en"), (None, long, "de"), (None, "alone", "en"), (6, long, "fr"), (6, long, "fr"), (3, long, "en"), (-1, "one two", "es")]
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 40, 2)] + [(6, 0, 1), (6, 1, 0), (6, None, None), (None, 1, 1), (999, 1, 1)]
    return docs, labels


def test_against_every_order(spark):
    docs, labels = made()
    frame = spark.createDataFrame([(*d, "p", 1, 2) for d in docs], "doc_id long, text string, lang string, part string, mask int, n int").repartition(3)
    known = spark.createDataFrame([(*x, "p") for x in labels], LABELS)
    rows = interaction.audit(frame, known).collect()
    assert {tuple(r) for r in rows} == brute(docs, labels) and len(rows) == 600 * len({lang or "" for _, _, lang in docs})
    assert interaction.audit(frame.limit(0), known).count() == 0
    assert interaction.audit(frame, known.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0


def test_other_parts(spark):
    docs, labels = made()
    frame = spark.createDataFrame([(d, t, i % 3) for i, (d, t, _) in enumerate(docs)], "doc_id long, text string, source int")
    found = {tuple(r) for r in interaction.audit(frame, spark.createDataFrame([(*x, "p") for x in labels], LABELS), "source").collect()}
    assert found == brute([(d, t, str(i % 3)) for i, (d, t, _) in enumerate(docs)], labels)


def test_corners_and_values():
    r = interaction.Removals({0: 5, 0b00011: 7, 0b10000: 2})
    assert [r.corner(x) for x in (0, 1, 2, 3, 16, 31)] == [0, 7, 7, 7, 2, 9]
    assert [r.shapley(1 << i) * 2 for i in range(5)] == [7, 7, 0, 0, 4]


@pytest.mark.parametrize("size", ["sf0.001"])
def test_sql(spark, size):
    folder = f"/root/testdata/{size}"
    read = lambda t: spark.read.parquet(f"{folder}/{t}.parquet")
    found = {tuple(r) for r in interaction.audit(read("documents"), read("labels")).collect()}
    with duckdb.connect() as con:
        for t in ("documents", "labels"):
            con.execute(f"CREATE VIEW {t} AS FROM '{folder}/{t}.parquet'")
        assert found == set(con.execute(interaction.oracle()).fetchall()) and found
