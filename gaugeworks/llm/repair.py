"""Conversation structure repair: the cheapest edits that give each conversation the form system?, (user, assistant)*.

Rows are dealt by the hash of their conversation and sorted by turn; each task reads them as a stream and cuts it into batches of
conversations. A batch is one recursive DuckDB query: each recursion advances one turn of all its conversations and keeps, for
every state of the grammar, the least cost and, of equal costs, the audit (the edits' initials) that is least in ASCII. States: 0 nothing
yet, 1 after the system's turn, 2 after a user's, 3 after an assistant's. An edit's letter tells the next state, so an audit says all: K
keeps a turn, R gives it the role that is due, D deletes it, I inserts an empty turn of the role that is due. Inserts stand before the row
that they make fit, so that of two audits of the same rows neither begins with the other, and the lesser stays the lesser, whatever follows.

A conversation over PART rows is cut into parts. A part behind the first is entered from every state; parts are chained by least
cost and audit afterwards, so recursions never exceed PART. Of a conversation longer than a batch, what passes on is four costs, the letters
and four running digests, never its texts: a conversation with a third of all rows streams through its task (its digest is
sequential by nature), and memory is one batch of rows and its audit.

Faults, the first that holds: blank, duplicate (role and text seen at an earlier row), truncated (the last character that isn't a
space is none of . ! ?). Blank and duplicate rows must go; a truncated row that stays costs 1.

Defined cases: null roles and texts are one space, so that such a text is blank and such a role unknown; null turns come first; rows of
one turn are taken by role, then text; repeated rows are duplicates but for the first; rows with a null conv_id are one
conversation, whose conv_id stays null; conversations whose rows are all absent have zeros, an empty audit and the digest of
nothing; very long texts and conversations are handled whole; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = 64
ROWS = 20_000
BYTES = 4 << 20
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
OTHER, SYSTEM, USER, ASSISTANT = range(4)  # what a role begins with; the last three are the states behind such a turn
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
GONE, CUT = 4, 8  # added to a row's role: it must go; it costs 1 if it stays
FOUND = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
DUE = {0: USER, 1: USER, 2: ASSISTANT, 3: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: What an audit that ends in a state still needs.
ENDS = {0: "", 1: "II", 2: "I", 3: ""}


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with faults by CRC-32 of conv_id:turn, modulo 20: 0 drops the row (column dropped), 1 empties the text, 2 removes
    its . ! ?, 3 repeats the row, 4 sets the role user. Nulls are one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20).alias("kind")
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind)
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role")), "dropped": F.col("kind") == 0})
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(F.col("kind") == 3, 1).otherwise(0)))).drop("kind", "copy")


def order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def judged(turns: DataFrame, absent: str | None = None) -> DataFrame:
    """conv_id, turn, role, text, absent, side (what the role begins with) and fault, dealt by conversation and in order there."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), (F.col(absent) if absent else F.lit(False)).alias("absent")).repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "absent", "role", "text").orderBy("turn")) > 1
    bare = F.rtrim("text", F.lit(SPACES))
    side = F.when(F.col("role").startswith("s"), SYSTEM).when(F.col("role").startswith("u"), USER).when(F.col("role").startswith("a"), ASSISTANT).otherwise(OTHER)
    rows = rows.withColumns({"again": again, "bare": bare, "side": side})
    fault = F.when(F.col("bare") == "", BLANK).when(F.col("again"), DUPLICATE).when(~F.substring("bare", -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    rows = rows.select("conv_id", "turn", "role", "text", "absent", "side", fault.alias("fault"), "again")
    return rows.sortWithinPartitions(F.col("conv_id"), *order(), "again").drop("again")


def moves() -> list[tuple[int, int, int, int, str]]:
    """(state, kind of row, next state, cost, letters) of each way to take in a row: inserts, then one edit."""
    out = []
    for start in range(4):
        state, letters = start, ""
        while True:
            for kind in range(16):
                side, gone, cut = kind & 3, kind & GONE, bool(kind & CUT)
                cost = 2 * len(letters)
                out.append((start, kind, state, cost + 3, letters + "D"))
                if not gone:
                    out.append((start, kind, DUE[state], cost + 2 + cut, letters + "R"))
                    if side == DUE[state] or (side == SYSTEM and state == 0):
                        out.append((start, kind, side, cost + cut, letters + "K"))
            if len(letters) == 2:
                break
            state, letters = DUE[state], letters + "I"
    return out


WALK = """
WITH RECURSIVE walk AS (
  SELECT part, entry, entry AS state, 0 AS n, 0::BIGINT AS cost, '' AS audit FROM starts
  UNION ALL
  SELECT part, entry, next, n + 1, best.cost, best.audit FROM (
    SELECT w.part, w.entry, m.next, w.n, min(struct_pack(cost := w.cost + m.cost, audit := w.audit || m.letters)) AS best
    FROM walk w JOIN turns t ON t.part = w.part AND t.n = w.n JOIN moves m ON m.state = w.state AND m.kind = t.kind
    GROUP BY ALL)
)
SELECT part, entry, state, cost, audit FROM walk JOIN sizes USING (part) WHERE n = size
"""


@dataclass
class Path:
    """The best edits that end in a state. Lists are linked: (what is before, ...)."""

    state: int
    cost: int
    letters: tuple | None
    waiting: tuple | None  # (before, state, rows, letters) that the digest doesn't hold yet
    digest: Any
    begun: bool

    def settle(self) -> Path:
        """The path with all its rows in the digest."""
        items, at = [], self.waiting
        while at:
            at, *item = at
            items.append(item)
        if not items:
            return self
        digest, begun = self.digest.copy(), self.begun
        for state, rows, letters in reversed(items):
            for role, text in replay(rows, letters, state):
                digest.update((f"\n{role}:{text}" if begun else f"{role}:{text}").encode())
                begun = True
        return Path(self.state, self.cost, self.letters, None, digest, begun)

    def audit(self) -> str:
        out, at = [], self.letters
        while at:
            at, letters = at
            out.append(letters)
        return "".join(reversed(out))


def replay(rows: list[tuple], letters: str, state: int) -> Iterator[tuple[str, str]]:
    """The repaired turns (role, text). rows: (role, text, side)."""
    at = 0
    for x in letters:
        if x == "I":
            state = DUE[state]
            yield NAMES[state], ""
            continue
        role, text, side = rows[at]
        at += 1
        if x == "K":
            state = side
            yield role, text
        elif x == "R":
            state = DUE[state]
            yield NAMES[state], text


class Conversation:
    """One conversation as its rows come."""

    def __init__(self, name: Any):
        self.name, self.paths = name, [Path(0, 0, None, None, hashlib.sha256(), False)]
        self.faults, self.illegal, self.side, self.low, self.high, self.distinct = [0, 0, 0, 0], 0, None, None, None, 0

    def see(self, turn: int | None, side: int, fault: int) -> None:
        self.faults[fault] += 1
        self.illegal += self.side is not None and (self.side, side) not in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))
        self.side = side
        if turn is not None and turn != self.high:  # turns ascend
            self.low, self.high, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1

    def chain(self, rows: list[tuple], found: dict[int, list[tuple[int, int, str]]]) -> None:
        """Go on by a part. paths are in their audits' order, so a path's place stands for its letters."""
        best: dict[int, tuple] = {}
        for rank, path in enumerate(self.paths):
            for state, cost, letters in found[path.state]:
                new = path.cost + cost, rank, letters
                if state not in best or new < best[state]:
                    best[state] = new
        ordered = sorted(best.items(), key=lambda x: x[1][1:])
        self.paths = [Path(state, cost, ((p := self.paths[rank]).letters, letters), (p.waiting, p.state, rows, letters), p.digest, p.begun) for state, (cost, rank, letters) in ordered]

    def result(self) -> tuple:
        cost, _, path = min((p.cost + 2 * len(ENDS[p.state]), rank, p) for rank, p in enumerate(self.paths))
        end = ENDS[path.state]
        path = Path(path.state, cost, (path.letters, end), (path.waiting, path.state, [], end), path.digest, path.begun).settle()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (self.name, gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED], self.illegal, cost, path.audit(), path.digest.hexdigest())


class Batch:
    """Parts of conversations, until they are walked together."""

    def __init__(self):
        import duckdb

        self.duck = duckdb.connect()
        for setting in ("threads = 1", "memory_limit = '500MB'", "temp_directory = ''"):
            self.duck.execute(f"SET {setting}")
        columns = [pa.array(x) for x in zip(*moves(), strict=True)]
        self.duck.register("moves", pa.Table.from_arrays(columns, ["state", "kind", "next", "cost", "letters"]))
        self.parts: list[tuple[Conversation, bool, list[tuple]]] = []
        self.rows = self.bytes = 0

    def add(self, conversation: Conversation, turn: int | None, role: str, text: str, side: int, fault: int) -> None:
        conversation.see(turn, side, fault)
        if not self.parts or self.parts[-1][0] is not conversation or len(self.parts[-1][2]) == PART:
            first = sum(conversation.faults) == 1
            self.parts.append((conversation, first, []))
        self.parts[-1][2].append((role, text, side, side + (GONE if fault in (BLANK, DUPLICATE) else CUT if fault == TRUNCATED else 0)))
        self.rows, self.bytes = self.rows + 1, self.bytes + len(text)

    def walk(self) -> None:
        """Take all parts into their conversations."""
        if not self.parts:
            return
        kinds = [(i, n, r[3]) for i, (_, _, rows) in enumerate(self.parts) for n, r in enumerate(rows)]
        starts = [(i, entry) for i, (_, first, _) in enumerate(self.parts) for entry in range(1 if first else 4)]
        table = lambda rows, names: pa.Table.from_arrays([pa.array(x, pa.int32()) for x in zip(*rows, strict=True)], names)
        self.duck.register("turns", table(kinds, ["part", "n", "kind"]))
        self.duck.register("starts", table(starts, ["part", "entry"]))
        self.duck.register("sizes", table([(i, len(p[2])) for i, p in enumerate(self.parts)], ["part", "size"]))
        found: list[dict[int, list]] = [{} for _ in self.parts]
        for part, entry, state, cost, audit in self.duck.execute(WALK).fetchall():
            found[part].setdefault(entry, []).append((state, cost, audit))
        for (conversation, _, rows), ways in zip(self.parts, found, strict=True):
            conversation.chain([r[:3] for r in rows], ways)
        self.parts, self.rows, self.bytes = [], 0, 0


def repair(turns: DataFrame, absent: str | None = None) -> DataFrame:
    """conv_id and FOUND of every conversation. turns: conv_id, turn, role, text. absent: a boolean column, true on rows that
    count for nothing but their conversation's being there.

    gaps: turns missing between the least and the largest; illegal: neighbours whose roles don't follow each other; cost and audit of
    the cheapest edits; repaired_sha256: of the repaired role:text lines."""
    kind = dict(turns.dtypes)["conv_id"]
    names = ["conv_id", *(x.split()[0] for x in FOUND.split(", "))]
    schema = pa.schema([pa.field(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in names[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, now, done = Batch(), None, []
        for batch in batches:
            told = batch.schema.field("conv_id")
            for name, turn, role, text, gone, side, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "absent", "side", "fault")), strict=True):
                if now is None or now.name != name:
                    if work.rows >= ROWS or work.bytes >= BYTES:
                        work.walk()
                        if now:
                            done.append(now)
                            now = None
                        yield take(done, told)
                        done = []
                    if now:
                        done.append(now)
                    now = Conversation(name)
                elif work.rows >= ROWS or work.bytes >= BYTES:
                    work.walk()  # a conversation longer than a batch goes on from its four paths
                    now.paths = [p.settle() for p in now.paths]
                if not gone:
                    work.add(now, turn, role, text, side, fault)
        work.walk()
        if now:
            done.append(now)
            yield take(done, told)

    def take(done: list[Conversation], told: pa.Field) -> pa.RecordBatch:
        rows = [c.result() for c in done]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(columns[0], told.type), *(pa.array(x, f.type) for x, f in zip(columns[1:], schema, strict=True))], names)

    return judged(turns, absent).mapInArrow(run, f"conv_id {kind}, {FOUND}")


def repaired_turns(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text, edit (K, R or I). found: repair(turns).

    An audit is cut at its rows and joined with them; roles that are due alternate from the first user on."""
    edits = found.select("conv_id", F.posexplode(F.regexp_extract_all("audit", F.lit("I*[KRD]|I+$"), F.lit(0))).alias("n", "letters"))
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order())) - 1).withColumnRenamed("conv_id", "row_conv")
    both = edits.join(rows.withColumnRenamed("n", "row_n"), F.col("conv_id").eqNullSafe(F.col("row_conv")) & (F.col("n") == F.col("row_n")), "left")
    each = both.select("conv_id", "n", "role", "text", F.posexplode(F.regexp_extract_all("letters", F.lit("[IKRD]"), F.lit(0))).alias("k", "edit")).filter("edit <> 'D'")
    w = Window.partitionBy("conv_id").orderBy("n", "k")
    each = each.withColumn("place", F.row_number().over(w) - 1)
    opens = F.first(F.when((F.col("edit") == "K") & F.col("role").startswith("s"), 1).otherwise(0)).over(w)
    due = F.when((F.col("place") - opens) % 2 == 0, "user").otherwise("assistant")
    return each.select("conv_id", "place", F.when(F.col("edit") == "K", F.col("role")).otherwise(due).alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"), "edit")


def oracle() -> str:
    """DuckDB SQL over the conversations table: damage, faults, and the cheapest edits by a recursion over whole conversations."""
    table = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))"
    code = "list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {code}), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295)"
    ways = ", ".join(str(x) for x in [(0, "s", 1), (0, "u", 2), (1, "u", 2), (2, "a", 3), (3, "u", 2)])
    return rf"""
WITH RECURSIVE tables AS (SELECT {table} AS crcs),
kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS kind FROM conversations, tables),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, range(2) r(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS n FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
  left(role, 1) AS side, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM placed),
judged AS (SELECT *, CASE WHEN bare = '' THEN 1 WHEN again THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM seen),
counts AS (SELECT conv_id, count(*) AS size, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
  count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before IS NOT NULL AND before || side NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
keeps AS (SELECT * FROM (VALUES {ways}) AS t(state, side, next)),
due AS (SELECT * FROM (VALUES (0, 2), (1, 2), (2, 3), (3, 2)) AS t(state, next)),
inserts AS (SELECT state, state AS mid, 0 AS k FROM due UNION ALL SELECT state, next, 1 FROM due UNION ALL SELECT a.state, b.next, 2 FROM due a JOIN due b ON b.state = a.next),
walk AS (
  SELECT conv_id, 0::BIGINT AS n, 0 AS state, 0::BIGINT AS cost, '' AS audit, ''::VARCHAR AS repaired FROM counts
  UNION ALL
  SELECT conv_id, n + 1, next, best.cost, best.audit, best.repaired FROM (
    SELECT w.conv_id, w.n, e.next, min(struct_pack(cost := w.cost + 2 * i.k + e.cost, audit := w.audit || repeat('I', i.k) || e.letter, repaired := w.repaired
      || CASE i.k WHEN 0 THEN '' WHEN 1 THEN CASE i.mid WHEN 2 THEN chr(10) || 'user:' ELSE chr(10) || 'assistant:' END ELSE CASE i.mid WHEN 3 THEN chr(10) || 'user:' || chr(10) || 'assistant:' ELSE chr(10) || 'assistant:' || chr(10) || 'user:' END END
      || e.line)) AS best
    FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.n = w.n JOIN inserts i ON i.state = w.state,
    LATERAL (SELECT i.mid AS next, 3 AS cost, 'D' AS letter, '' AS line
      UNION ALL SELECT d.next, 2 + (j.fault = 3)::INT, 'R', chr(10) || CASE d.next WHEN 2 THEN 'user:' ELSE 'assistant:' END || j.text FROM due d WHERE d.state = i.mid AND j.fault NOT IN (1, 2)
      UNION ALL SELECT k.next, (j.fault = 3)::INT, 'K', chr(10) || j.role || ':' || j.text FROM keeps k WHERE k.state = i.mid AND k.side = j.side AND j.fault NOT IN (1, 2)) e
    GROUP BY ALL)
),
ends AS (SELECT w.conv_id, min(struct_pack(cost := w.cost + x.cost, audit := w.audit || x.letters, repaired := w.repaired || x.line)) AS best
  FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND w.n = c.size
  JOIN (VALUES (0, 0, '', ''), (1, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 2, 'I', chr(10) || 'assistant:'), (3, 0, '', '')) AS x(state, cost, letters, line) ON x.state = w.state GROUP BY w.conv_id),
names AS (SELECT DISTINCT conv_id FROM conversations)
SELECT names.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(substr(best.repaired, 2), '')) AS repaired_sha256
FROM names LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM names.conv_id LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM names.conv_id"""
