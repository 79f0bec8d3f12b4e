"""Preference formatting against plain Python."""

import pytest

from gaugeworks.llm import chat


def render(turns):
    return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)


def masked(turns):
    out, at = [], 0
    for role, text in turns:
        begin = at + len(f"<|{role}|>\n")
        at = begin + len(text) + len("<|end|>\n")
        if role == "assistant":
            out.append(f"{begin}:{at}")
    return ",".join(out)


CONVERSATIONS = {
    0: [("system", "s"), ("user", "hi"), ("assistant", "good é🙂"), ("user", "more")], 1: [("system", "s"), ("user", "hi"), ("assistant", "bad")],
    2: [("user", "a")], 3: [("user", "a")], 4: [("user", "b"), ("assistant", "x")], 5: [("user", "b")], 6: [("user", "only")], 8: [("user", "")], 9: [("assistant", "q" * 5000)],
}


def judge(r, a, b):
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert (r.n_common, r.prompt, r.chosen_completion, r.rejected_completion) == (n, render(a[:n]), render(a[n:]), render(b[n:]))
    assert (r.chosen_mask, r.rejected_mask, r.usable) == (masked(a[n:]), masked(b[n:]), len(a) > n and len(b) > n)


def broken(turns):
    last = max((i for i, (role, _) in enumerate(turns) if role == "assistant"), default=None)
    return [(r, " ".join(t.split(" ")[::-1])) if i == last else (r, t) for i, (r, t) in enumerate(turns)]


def test_pairs(spark):
    """Given pairs: conversations 2k and 2k + 1."""
    both = [(k // 2, CONVERSATIONS[k], CONVERSATIONS[k + 1]) for k in CONVERSATIONS if k % 2 == 0 and k + 1 in CONVERSATIONS]
    frame = spark.createDataFrame(both, "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    found = {r.pair_id: r for r in chat.preference_pairs(frame).collect()}
    assert sorted(found) == sorted(x[0] for x in both)
    for k, a, b in both:
        judge(found[k], a, b)


def test_corrupted(spark):
    """Every conversation gives a pair that forks at its last answer."""
    given = CONVERSATIONS | {20: [("user", "q"), ("assistant", "one two  three"), ("user", "and"), ("assistant", " a b ")], 21: [("assistant", "the long " * 200_000)]}
    rows = [(c, i, r, t, "extra", "x") for c, turns in given.items() for i, (r, t) in enumerate(turns)] + [(None, 0, "user", "lost", "extra", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string, chosen string").repartition(3)
    found = {r.pair_id: r for r in chat.preference_pairs(chat.corrupted_pairs(frame)).collect()}
    assert sorted(found) == sorted(given) and found[20].n_common == 3 and found[20].usable and not found[2].usable
    for k, turns in given.items():
        judge(found[k], turns, broken(turns))


def test_edge_cases(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat.preference_pairs(chat.corrupted_pairs(spark.createDataFrame([], schema))).count() == 0
    rows = [(0, None, None, None), (0, 1, "user", "x"), (0, 1, "user", "x"), (1, None, None, None), (1, 1, "assistant", None)]
    found = {r.pair_id: r for r in chat.preference_pairs(chat.corrupted_pairs(spark.createDataFrame(rows, schema))).collect()}
    assert (found[0].n_common, found[0].prompt, found[0].usable) == (3, "<||>\n<|end|>\n" + render([("user", "x")] * 2), False)
    assert (found[1].n_common, found[1].chosen_completion, found[1].usable) == (2, "", False)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_sql(spark, folder):
    import duckdb

    found = duckdb.sql(chat.oracle().replace("FROM conversations", f"FROM '{folder}/conversations.parquet'"))
    mine = chat.preference_pairs(chat.corrupted_pairs(spark.read.parquet(f"{folder}/conversations.parquet")))
    names = sorted(mine.columns)
    assert sorted(map(tuple, mine.select(*names).collect())) == sorted(found.select(*names).fetchall())
