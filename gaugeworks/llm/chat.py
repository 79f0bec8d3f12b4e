"""Preference formatting: pairs of chosen and rejected conversations as one prompt and two masked completions.

The turns of both conversations are compared from the first on; the longest common prefix of equal (role, text) turns is
rendered once, as the prompt. The rest of each is its completion; its mask lists the spans of the completion that the
assistant says (text and end mark), where loss is taken. Turns are ordered by number, then role and text. A conversation
becomes one row, so a task holds the turns of one conversation at a time, which the result does too.

Where a table has no preferences, `corrupted_pairs` makes them: the conversation itself is chosen, and rejected is the same
one with the words of its last assistant turn in reverse order, a fluent answer against a broken one. The pair forks there.

Defined cases: null roles and texts count as empty, a null turn number comes first; turns without a conversation id belong
to no conversation; repeated turns are all rendered; ties in the turn number go by role, then text; when one conversation is
a prefix of the other, or both are equal (no assistant turn, or its words read alike both ways), the pair stays with an empty
completion and isn't usable; an empty table gives no rows; very long turns are rendered whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, MIDDLE, END = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def turns_of(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """conv_id and turns, an array of (role, text)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = conversations.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return rows.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(BEGIN), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(END))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _mask(turns: Column) -> Column:
    """start:end of what the assistant says, code points, comma-joined."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        begin = state["at"] + F.length(turn["role"]) + len(BEGIN) + len(MIDDLE)
        end = begin + F.length(turn["text"]) + len(END)
        spans = F.when(turn["role"] == TRAINED, F.concat(state["spans"], F.array(F.concat_ws(":", begin, end)))).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda s: F.array_join(s["spans"], ","))


def preference_pairs(pairs: DataFrame) -> DataFrame:
    """pairs: pair_id, chosen and rejected (arrays of role and text). One row for each pair."""
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("equal"))
    same = F.zip_with("chosen", "rejected", lambda a, b: a.eqNullSafe(b))
    common = F.aggregate(same, start, lambda s, x: F.struct((s["n"] + F.when(s["equal"] & x, 1).otherwise(0)).alias("n"), (s["equal"] & x).alias("equal")), lambda s: s["n"])
    rows = pairs.select("pair_id", "chosen", "rejected", common.alias("common"))
    rest = {k: F.slice(k, F.col("common") + 1, F.greatest(F.size(k), F.lit(1))) for k in ("chosen", "rejected")}
    rows = rows.select("pair_id", "common", F.slice("chosen", F.lit(1), F.col("common")).alias("shared"), *(v.alias(k) for k, v in rest.items()))
    return rows.select(
        "pair_id", F.col("common").cast("long").alias("n_common"), _joined(F.col("shared")).alias("prompt"),
        *(f(F.col(k)).alias(f"{k}_{n}") for k in ("chosen", "rejected") for n, f in (("completion", _joined), ("mask", _mask))),
        ((F.size("chosen") > 0) & (F.size("rejected") > 0)).alias("usable"),
    )


def corrupted_pairs(conversations: DataFrame) -> DataFrame:
    """A pair for each conversation: itself, and itself with the words of the last assistant turn reversed."""
    turns = turns_of(conversations)
    last = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == TRAINED, i)))
    broken = lambda t: F.struct(t["role"].alias("role"), F.array_join(F.reverse(F.split(t["text"], " ", -1)), " ").alias("text"))
    rows = turns.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), F.coalesce(last, F.lit(-1)).alias("last"))
    return rows.select("pair_id", "chosen", F.transform("chosen", lambda t, i: F.when(i == F.col("last"), broken(t)).otherwise(t)).alias("rejected"))


ORACLE = """
WITH t AS (SELECT conv_id AS pair_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS c
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
l AS (SELECT *, coalesce(list_max(list_filter(range(1, 1 + len(c)), lambda i: c[i].role = 'assistant')), 0) AS f FROM t),
p AS (SELECT pair_id, c, list_transform(range(1, 1 + len(c)), lambda i: CASE WHEN i = f THEN struct_pack(role := c[i].role, text := array_to_string(list_reverse(string_split(c[i].text, ' ')), ' ')) ELSE c[i] END) AS r FROM l),
n AS (SELECT *, coalesce(list_min(list_filter(range(1, 1 + least(len(c), len(r))), lambda i: c[i] <> r[i])) - 1, least(len(c), len(r))) AS k FROM p),
s AS (SELECT pair_id, k, c[1:k] AS common, c[k + 1:] AS c, r[k + 1:] AS r FROM n)
SELECT pair_id, CAST(k AS BIGINT) AS n_common, %s AS prompt, %s AS chosen_completion, %s AS chosen_mask, %s AS rejected_completion, %s AS rejected_mask, len(c) > 0 AND len(r) > 0 AS usable FROM s
"""


def oracle() -> str:
    """DuckDB SQL for the pairs of corrupted_pairs."""
    joined = lambda x: f"coalesce(array_to_string(list_transform({x}, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '')"
    frame, head, end = len(BEGIN) + len(MIDDLE) + len(END), len(BEGIN) + len(MIDDLE), len(END)
    before = lambda x: f"coalesce(list_sum(list_transform({x}[1:i - 1], lambda t: length(t.role) + length(t.text) + {frame})), 0) + length({x}[i].role) + {head}"
    spans = lambda x: f"coalesce(array_to_string(list_transform(list_filter(range(1, len({x}) + 1), lambda i: {x}[i].role = '{TRAINED}'), lambda i: CAST({before(x)} AS BIGINT) || ':' || CAST({before(x)} + length({x}[i].text) + {end} AS BIGINT)), ','), '')"
    return ORACLE % (joined("common"), joined("c"), spans("c"), joined("r"), spans("r"))
