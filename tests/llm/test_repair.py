"""Conversation repair against a search over all edits in plain Python, against its SQL, and its texts against its digests."""

import hashlib
import heapq
import random
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeworks.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, audit string, dropped string"
SPACES = " \t\n\x0b\x0c\r"
EMPTY = hashlib.sha256(b"").hexdigest()


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
        out += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute(rows):
    """Dijkstra over (rows taken, output so far as a state), audits in the order; by conversation."""
    by = {c: [] for c, *_ in rows}
    for c, *r in damaged(rows):
        by[c].append(r)
    out = set()
    for c, mine in by.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in mine:
            bare = text.rstrip(SPACES)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, *_ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[1][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        heap, done = [(0, "", 0, "", ())], set()
        while True:
            cost, audit, at, state, turns_ = heapq.heappop(heap)
            if at == len(mine) and state in ("", "a"):
                break
            if (at, state, audit) in done:
                continue
            done.add((at, state, audit))
            due = "a" if state == "u" else "u"
            full = {"u": "user", "a": "assistant"}[due]
            if not audit.endswith("III"):
                heapq.heappush(heap, (cost + 2, audit + "I", at, due, (*turns_, (full, ""))))
            if at < len(mine):
                _, role, text = mine[at]
                heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state, turns_))
                if faults[at] not in ("blank", "duplicate"):
                    more = faults[at] == "truncated"
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", at + 1, due, (*turns_, (full, text))))
                    if role[:1] == due or (role[:1] == "s" and state == ""):
                        heapq.heappush(heap, (cost + more, audit + "K", at + 1, role[:1], (*turns_, (role, text))))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns_).encode()).hexdigest()
        out.add((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "d") for r in rows], SCHEMA)


def run(spark, rows, parts=2):
    turns = repair.damage(frame(spark, rows).repartition(parts))
    return repair.repair(turns, "dropped")


ROLES, TEXTS = ["user", "assistant", "system", "tool", "User", None, "", "ass", "sys"], ["Yes.", "No", "What?", None, "", " \n", "Go on!", "a b c . ", "x.\x85", "same.", "same."]


def random_rows(seed, conversations=60, longest=7):
    r = random.Random(seed)
    rows = []
    for c in range(conversations):
        for k in range(r.randint(1, longest)):
            turn = None if r.random() < 0.05 else k + (r.random() < 0.2) * r.randint(0, 2)
            role = r.choice(ROLES) if r.random() < 0.4 else ("user", "assistant")[k % 2]
            rows.append((c if c else None, turn, role, r.choice(TEXTS)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_search(spark, seed):
    rows = random_rows(seed)
    assert {tuple(r) for r in run(spark, rows).collect()} == brute(rows)


def walk(rows):
    """The rows of one conversation through a batch, without Spark."""
    work, c = repair.Batch(), repair.Conversation(1)
    for turn, (role, text, side, fault) in enumerate(rows):
        if work.rows >= repair.ROWS:
            work.walk()
            c.paths = [p.settle() for p in c.paths]
        work.add(c, turn, role, text, side, fault)
    work.walk()
    return c.result()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool"]), st.sampled_from([0, 0, 0, 1, 3])), max_size=30), st.integers(1, 9), st.integers(1, 5))
def test_parts_change_nothing(items, part, batch):
    """Any size of parts and batches gives the same cost, audit and digest."""
    side = {"user": repair.USER, "assistant": repair.ASSISTANT, "system": repair.SYSTEM, "tool": repair.OTHER}
    rows = [(role, f"{i}.", side[role], fault) for i, (role, fault) in enumerate(items)]
    whole, old = walk(rows), (repair.PART, repair.ROWS)
    try:
        repair.PART, repair.ROWS = part, batch
        assert walk(rows) == whole
    finally:
        repair.PART, repair.ROWS = old


def test_long_conversation(spark):
    r = random.Random(3)
    rows = [(7, i, r.choice(["user", "assistant"]), f"turn {i}.") for i in range(25_000)] + [(8, 0, "user", "Hi."), (8, 1, "assistant", "word " * 300_000 + ".")]
    turns = repair.damage(frame(spark, rows)).filter("not dropped")
    found = repair.repair(turns)
    assert sorted(r.conv_id for r in found.collect()) == [7, 8]
    digests(turns, found)


def digests(turns, found):
    by = {}
    for t in repair.repaired_turns(turns, found).orderBy("conv_id", "place").collect():
        by.setdefault(t.conv_id, []).append(f"{t.role}:{t.text}")
    for r in found.collect():
        assert hashlib.sha256("\n".join(by.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256


def test_repaired_turns(spark):
    turns = repair.damage(frame(spark, random_rows(4))).filter("not dropped")
    found = repair.repair(turns)
    digests(turns, found)
    initials = {}
    for t in repair.repaired_turns(turns, found).orderBy("conv_id", "place").collect():
        initials[t.conv_id] = initials.get(t.conv_id, "") + t.role[:1]
    assert all(set(x.removeprefix("s").split("ua")) == {""} for x in initials.values())


def test_edge_cases(spark):
    rows = random_rows(5, 10)
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    all_gone = {r for r in run(spark, [*rows, (gone, 0, "user", "x.")]).collect() if r.conv_id == gone}
    assert [tuple(r) for r in all_gone] == [(gone, 0, 0, 0, 0, 0, 0, "", EMPTY)]
    assert run(spark, rows).filter("conv_id = -1").count() == 0 and repair.repair(frame(spark, rows).limit(0)).count() == 0
    twice = rows * 2
    assert {tuple(r) for r in run(spark, twice, 5).collect()} == brute(twice)
    assert {tuple(r) for r in run(spark, [(None, None, None, None)]).collect()} == brute([(None, None, None, None)])


def test_sql(spark):
    path = "/root/testdata/sf0.01/conversations.parquet"
    found = {tuple(r) for r in repair.repair(repair.damage(spark.read.parquet(path)), "dropped").collect()}
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW conversations AS FROM '{path}'")
        assert found == set(con.execute(repair.oracle()).fetchall()) and len(found) > 50
        made = frame(spark, random_rows(6)).drop("audit", "dropped").toPandas()
        con.execute("CREATE OR REPLACE VIEW conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, text FROM made")
        assert set(con.execute(repair.oracle()).fetchall()) == brute(random_rows(6))
