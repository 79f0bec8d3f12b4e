"""Filter interaction audit: what each of five filters removes, in every order, by a polynomial for each part.

A document's mask says which filters it fails. The counts of the 32 masks of a part give the multilinear polynomial of its
removals, R(x) = sum over masks of count * (1 - product over the mask's filters of (1 - x_i)): at a corner (each x_i 0 or 1) it is
the number that the filters with x_i = 1 remove together, so corners give every step of every order. A filter's Shapley value is
the integral of R's partial derivative along the diagonal, which is the sum of coefficient / size over the sets that hold the
filter, in exact rationals; times 120 it is the sum over all orders. Labelled losses are corners of polynomials over the labelled
documents alone.

Filters: A under 200 words, B fewer than half of the words distinct, C over 3 % capitals A-Z, D a character of #$%&*|, E a
text that a smaller doc_id has as well.

Scale: a text is read once and becomes a mask and its SHA-256 (which stands for it in E). Only these narrow rows are shuffled;
rows of one text are summed by (text, part, label) with partial sums in the map tasks, so a text with many copies is never a group in one
task: the smallest doc_id is looked for among the sums. A part's group is at most 32 masks.

Defined cases: null texts are empty and fail A alone; a null part is the empty string; rows without an id never fail E and are no
smaller id for others; of repeated rows of the smallest id none fails E; a document is good (toxic) if any of its label rows says so,
and labels without an id count nowhere; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
SPACES = r"[\x20\x09-\x0D]+"
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def mask_of(text: Column, words: Column) -> Column:
    """The bits of A to D; E needs the other rows."""
    n = F.size(words)
    fails = (
        n < 200,
        100 * F.size(F.array_distinct(words)) < 50 * n,
        100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.length(text),
        text.rlike("[#$%&*|]"),
    )
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def mask_counts(documents: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: documents of a part by the set of filters that they fail."""
    rows = documents.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACES), ""))
    # rows without an id match no label; each input partition has a key of its own for them
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("none "), F.spark_partition_id().cast("string")))
    rows = rows.select("doc_id", "part", mask_of(F.col("text"), F.col("words")).alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"), key.alias("key"))
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("key")).agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    rows = rows.join(known.filter("good or toxic"), "key", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    kind = ["digest", "part", "mask", "good", "toxic"]
    ids = rows.groupBy(*kind, "doc_id").agg(F.count("*").alias("n"))
    named = F.col("doc_id").isNotNull()
    sums = ids.groupBy(*kind).agg(F.sum(F.when(named, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(named, 0).otherwise(F.col("n"))).alias("unnamed"), F.min(F.when(named, F.struct("doc_id", "n"))).alias("first"))
    # a text has a sum for each part and label at most
    sums = sums.withColumn("least", F.min("first.doc_id").over(Window.partitionBy("digest")))
    originals = F.col("unnamed") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    copies = F.col("n") + F.col("unnamed") - originals
    split = F.explode(F.array(F.struct(F.col("mask"), originals.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), copies.alias("n"))))
    found = sums.select("part", "good", "toxic", split.alias("s")).filter("s.n > 0 or s.mask < 16")
    counted = [F.sum("s.n").alias("n"), *(F.sum(F.when(F.col(c), F.col("s.n")).otherwise(0)).alias(c) for c in ("good", "toxic"))]
    return found.groupBy("part", F.col("s.mask").alias("mask")).agg(*counted)


class Removals:
    """The polynomial of removals: a coefficient for each set of filters, a set being a number of bits."""

    def __init__(self, counts: dict[int, int]):
        self.coefficients = dict.fromkeys(range(1, 1 << len(FILTERS)), 0)
        for mask, n in counts.items():
            for s in self.coefficients:
                if s & mask == s:
                    self.coefficients[s] += n if s.bit_count() % 2 else -n

    def corner(self, on: int) -> int:
        """How many the filters in `on` remove together."""
        return sum(c for s, c in self.coefficients.items() if s & on == s)

    def shapley(self, bit: int) -> Fraction:
        """The integral of the partial derivative by x_bit, all variables equal, from 0 to 1."""
        return sum((Fraction(c, s.bit_count()) for s, c in self.coefficients.items() if s & bit), Fraction(0))


def audit_part(counts: pd.DataFrame) -> pd.DataFrame:
    """All orders and steps of one part, from its mask counts."""
    masks = counts["mask"].tolist()
    total, good, toxic = (Removals(dict(zip(masks, counts[c].tolist(), strict=True))) for c in ("n", "good", "toxic"))
    documents, every = int(counts["n"].sum()), (1 << len(FILTERS)) - 1
    rows = []
    orders = ["".join(x) for x in itertools.permutations(FILTERS)]
    bits = {f: 1 << i for i, f in enumerate(FILTERS)}
    values = {f: int(total.shapley(b) * len(orders)) for f, b in bits.items()}
    for order in orders:
        on = 0
        for step, f in enumerate(order, 1):
            before, on = on, on | bits[f]
            removed = total.corner(on) - total.corner(before)
            rows.append((
                counts["part"].iloc[0], order, step, documents - total.corner(on), removed, total.corner(bits[f]) - removed, total.corner(every) - total.corner(every ^ bits[f]),
                good.corner(on) - good.corner(before), toxic.corner(on) - toxic.corner(before), values[f],
            ))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])


def audit(documents: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step, by SCHEMA. labels: doc_id, quality, toxic."""
    return mask_counts(documents, labels, part).groupBy("part").applyInPandas(audit_part, SCHEMA)


def oracle() -> str:
    """DuckDB SQL: every order is applied to the mask counts, step by step."""
    letters = "(VALUES ('A', 0), ('B', 1), ('C', 2), ('D', 3), ('E', 4))"
    names = [f"f{i}" for i in range(5)]
    orders = f"SELECT {', '.join(f'{n}.c AS c{i}' for i, n in enumerate(names))} FROM " + ", ".join(f"letters {n}" for n in names) + " WHERE " + " AND ".join(f"f{j}.c <> f{i}.c" for i in range(5) for j in range(i))
    return rf"""
WITH letters AS (SELECT * FROM {letters} AS t(c, bit)),
texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
flags AS (SELECT doc_id, part,
  (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask,
  EXISTS (FROM labels l WHERE l.doc_id = texts.doc_id AND l.quality = 1) AS good, EXISTS (FROM labels l WHERE l.doc_id = texts.doc_id AND l.toxic = 1) AS toxic FROM texts),
masks AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM flags GROUP BY ALL),
orders AS ({orders}),
steps AS (SELECT c0 || c1 || c2 || c3 || c4 AS filter_order, step::INT AS step, substr(c0 || c1 || c2 || c3 || c4, step, 1) AS c, left(c0 || c1 || c2 || c3 || c4, step - 1) AS earlier FROM orders, range(1, 6) AS r(step)),
bits AS (SELECT filter_order, step, c, (SELECT 1 << bit FROM letters l WHERE l.c = steps.c) AS own, (SELECT coalesce(sum(1 << bit), 0)::INT FROM letters l WHERE contains(steps.earlier, l.c)) AS before FROM steps),
counted AS (SELECT part, filter_order, step, c,
  coalesce(sum(n) FILTER (mask & (before | own) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & own > 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & before > 0 AND mask & own > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & before = 0 AND mask & own > 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & own > 0), 0)::BIGINT AS toxic_lost
  FROM masks, bits GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley FROM counted"""
