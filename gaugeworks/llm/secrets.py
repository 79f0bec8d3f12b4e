"""Secret scans by trigram queries, in DataFrame operations only.

For each rule a Boolean query of trigrams is derived from its regular expression: what every match must hold, after
lower-casing A-Z. The index has the trigrams of all queries as terms and texts as documents; it is kept by document, beside
the text: each row has the list of the terms that it holds. Intersecting postings is then a test of a row's own list, and
neither postings nor texts are shuffled (grouping postings (trigram, row) by row gave the same lists, and a join that moved
every text). A row whose list satisfies a rule's query is a candidate, and only there the expression runs. Rules without
mandatory trigrams run on every text. Positions are code points from 0, ends exclusive.

Defined cases: a null text counts as empty and has no spans; repeated rows each get theirs; an empty table gives no
rows; very long texts are searched whole; other columns pass through, but one of the output's name is replaced.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_parser = re._parser  # the standard library's expression parser


@dataclass(frozen=True)
class Rule:
    """An expression that Java and Python read alike; of its matches those with `least` code points in `group` count."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    base: bool = False


# The three base kinds, in their order.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16, 0, True),
    Rule("hex", r"[0-9a-f]{32,}", 32, 0, True),  # the runs of [0-9a-f]+ that have 32 characters
)
RULES = (
    *BASE,
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9+/_.=-]{16,}"),
)

Query = frozenset  # alternatives, each a set of trigrams that must all be there; an empty one is always satisfied
ALWAYS: Query = frozenset([frozenset()])
MOST = 64


def _least(alternatives) -> Query:
    """Without alternatives that hold another one."""
    found = set(alternatives)
    return frozenset(a for a in found if not any(b < a for b in found))


def _both(a: Query, b: Query) -> Query:
    joint = _least(x | y for x in a for y in b)
    return joint if len(joint) <= MOST else min(a, b, key=len)


def _of(strings: set[str]) -> Query:
    folded = {fold(s) for s in strings}
    return _least(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in folded) if folded else ALWAYS


def fold(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def _strings(items) -> set[str] | None:
    """All strings that the items match, or None if they are many."""
    found = {""}
    for op, arg in items:
        op = str(op)
        if op == "LITERAL":
            part = {chr(arg)}
        elif op == "AT":
            part = {""}
        elif op == "IN":
            part = set()
            for kind, x in arg:
                if str(kind) == "LITERAL":
                    part.add(chr(x))
                elif str(kind) == "RANGE" and x[1] - x[0] < 8:
                    part |= {chr(c) for c in range(x[0], x[1] + 1)}
                else:
                    return None
        elif op == "SUBPATTERN":
            part = _strings(arg[3])
        elif op == "BRANCH":
            each = [_strings(x) for x in arg[1]]
            part = None if None in each else set().union(*each)
        elif op == "MAX_REPEAT" and arg[1] <= 8:
            one, part = _strings(arg[2]), None
            if one is not None and sum(len(one) ** n for n in range(arg[0], arg[1] + 1)) <= MOST:
                part = {"".join(x) for n in range(arg[0], arg[1] + 1) for x in itertools.product(one, repeat=n)}
        else:
            part = None
        if part is None or len(found) * len(part) > MOST:
            return None
        found = {a + b for a in found for b in part}
    return found


def _query(items) -> Query:
    found, run = ALWAYS, {""}
    for item in items:
        part = _strings([item])
        if part is not None and len(run) * len(part) <= MOST:
            run = {a + b for a in run for b in part}
            continue
        found, run = _both(found, _of(run)), {""}
        op, arg = str(item[0]), item[1]
        if op == "SUBPATTERN":
            found = _both(found, _query(arg[3]))
        elif op == "BRANCH":
            found = _both(found, _least(set().union(*(_query(x) for x in arg[1]))))
        elif op == "MAX_REPEAT" and arg[0]:
            found = _both(found, _query(arg[2]))
    return _both(found, _of(run))


def trigram_query(pattern: str) -> Query:
    """What a text must hold to match, as alternatives of trigram sets over text with A-Z lower-cased."""
    return _query(list(_parser.parse(pattern)))


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, kind, end) of a rule's matches."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    gaps = F.split(text, rule.pattern, -1)
    judged = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    steps = F.arrays_zip(F.transform(whole, F.length).alias("n"), F.transform(gaps, F.length).alias("gap"), F.transform(judged, F.length).alias("judged"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("found"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + F.coalesce(x["n"], F.lit(0))
        keep = x["n"].isNotNull() & (x["judged"] >= rule.least)
        one = F.array(F.struct(begin.alias("start"), F.lit(number).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(keep, F.concat(state["found"], one)).otherwise(state["found"]).alias("found"))

    return F.when(F.size(whole) > 0, F.aggregate(steps, start, step, lambda x: x["found"])).otherwise(none)


def find_secrets(documents: DataFrame, rules: tuple[Rule, ...] = RULES, output: str = "secret_spans") -> DataFrame:
    """documents (with a text column) and, in `output`, the sorted spans (start, kind: the rule's number, end)."""
    queries = [trigram_query(r.pattern) for r in rules]
    indexed = [i for i, q in enumerate(queries) if frozenset() not in q]
    trigrams = sorted(set().union(*(a for i in indexed for a in queries[i]))) if indexed else []
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    text = F.col("t")
    folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = documents.select(F.struct("*").alias("row")).select("row", F.coalesce("row.text", F.lit("")).alias("t"))
    held = F.array_compact(F.array(*(F.when(F.contains(F.col("folded"), F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams))))
    rows = rows.select("row", "t", folded.alias("folded")).select("row", "t", (held if trigrams else F.array().cast("array<int>")).alias("trigrams"))

    def satisfied(query: Query) -> Column:
        out = F.lit(False)
        for alternative in sorted(map(sorted, query)):
            out |= F.size(F.array_except(F.array(*(F.lit(trigrams.index(t)) for t in alternative)), "trigrams")) == 0
        return out

    found = [F.when(satisfied(queries[i]), spans_of(text, r, i)).otherwise(none) if i in indexed else spans_of(text, r, i) for i, r in enumerate(rules)]
    spans = F.array_sort(F.concat(*found)) if found else none
    return rows.select(*(F.col(f"row.`{c}`").alias(c) for c in documents.columns if c != output), spans.alias(output))


def spelled(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def _counting(kind: int):
    return lambda n, k: n + F.when(k == kind, 1).otherwise(0)


def secret_rows(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each document: doc_id, counts and digest of the base kinds, all spans."""
    found = find_secrets(documents.select("doc_id", "text"), rules, "found")
    base = [i for i, r in enumerate(rules) if r.base]
    kinds = F.transform("found", lambda s: s["kind"])
    counts = [F.aggregate(kinds, F.lit(0).cast("long"), _counting(i)).alias(f"n_{rules[i].kind}") for i in base]
    return found.select("doc_id", *counts, F.sha2(spelled(F.filter("found", lambda s: s["kind"].isin(base)), rules), 256).alias("base_sha256"), spelled(F.col("found"), rules).alias("spans"))


def redact(documents: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """documents with each span, or run of overlapping spans, replaced by the mark; null texts stay null."""
    output = "secret_spans"
    while output in documents.columns:
        output += "_"
    found = find_secrets(documents, rules, output)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, s: Column) -> Column:
        apart = (s["start"] > state["at"]) | ((s["start"] == state["at"]) & (F.size(state["parts"]) == 0))
        piece = F.array(F.substring(F.col("text"), state["at"].cast("int") + 1, (s["start"] - state["at"]).cast("int")), F.lit(mark))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(apart, F.concat(state["parts"], piece)).otherwise(state["parts"]).alias("parts"))

    def finish(state: Column) -> Column:
        return F.concat(F.array_join(state["parts"], ""), F.substring(F.col("text"), state["at"].cast("int") + 1, F.length("text")))

    text = F.when(F.size(output) > 0, F.aggregate(output, start, step, finish)).otherwise(F.col("text"))
    return found.select(*(text.alias("text") if c == "text" else F.col(f"`{c}`") for c in documents.columns))


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for secret_rows over documents: every rule on every text."""
    ctes = []
    for i, r in enumerate(rules):
        pattern = r.pattern.removeprefix("(?i)")
        if pattern != r.pattern:  # either case of ASCII letters alone, outside of sets
            pattern = re.sub(r"\[[^]]*\]|\\x..|[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]" if len(m[0]) == 1 else m[0], pattern)
        quoted = "'" + pattern.replace("'", "''") + "'"
        ctes.append(f"m{i} AS (SELECT rid, {i} AS kind, regexp_extract_all(t, {quoted}, 0) AS w, regexp_extract_all(t, {quoted}, {r.group}) AS j, string_split_regex(t, {quoted}) AS p FROM d)")
        ctes.append(
            f"s{i} AS (SELECT rid, kind, unnest(range(1, len(w) + 1)) AS k, w, j, p FROM m{i} WHERE len(w) > 0), "
            f"e{i} AS (SELECT rid, kind, list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:k-1], lambda x: length(x))), 0) AS s, length(w[k]) AS n FROM s{i} WHERE length(j[k]) >= {r.least})"
        )
    every = " UNION ALL ".join(f"SELECT * FROM e{i}" for i in range(len(rules)))
    names = "[" + ", ".join(f"'{r.kind}'" for r in rules) + "]"
    base = [i for i, r in enumerate(rules) if r.base]
    counts = ", ".join(f"CAST(count(a.kind) FILTER (a.kind = {i}) AS BIGINT) AS n_{rules[i].kind}" for i in base)
    is_base = f"a.kind IN ({', '.join(map(str, base))})"
    return (
        "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), "
        + ", ".join(ctes)
        + f", a AS (SELECT rid, kind, CAST(s AS BIGINT) AS s, {names}[kind + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT) AS x FROM ({every})) "
        + f"SELECT doc_id, {counts}, sha256(coalesce(string_agg(a.x, ',' ORDER BY a.s, a.kind) FILTER ({is_base}), '')) AS base_sha256, coalesce(string_agg(a.x, ',' ORDER BY a.s, a.kind), '') AS spans FROM d LEFT JOIN a USING (rid) GROUP BY d.rid, doc_id"
    )
