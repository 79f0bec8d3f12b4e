"""URL filters: longest host and path rule, else a ratio of two character language models. DataFrame operations only.

Two smoothed variable-order Markov models of host and path, up to ORDER characters of context: rejected are URLs one of
whose host's words (between dots and hyphens) is in REJECT_WORDS, accepted the others. Each model interpolates the orders by
Witten and Bell's rule, so a context weighs as it has been seen. A URL's score is the difference of its log-likelihoods
divided by its length. Hosts are dealt to FOLDS folds by hash; the models count the URLs of all but the first fold, and the
first, whose hosts they haven't seen, calibrates them: the scores of both classes, taken as normal with one variance, and
their shares there give a probability, and a URL is blocked at REJECT_AT or more. Where the first fold or the others lack a
class, all URLs count for both.

Counts are exact and lie in a table of all n-grams, which grows with the input and is never collected. Probabilities are
joined up order by order; a key of these joins has as many rows as there are characters. The scores are joined from the
distinct windows of ORDER + 1 characters; windows with one in NGRAMS places or more, of which there are NGRAMS at most,
are broadcast, so that no key of the other join has many rows. What is collected are sums.

Defined cases: a null url or one without :// has an empty host and path, fits no rule and is allowed; without URLs of both
classes, and in an empty table, everything that no rule blocks is allowed; very long URLs are scored whole; of rules of one
length that fit, the last by text wins (two such rules are equal); repeated rows each get a row; other columns pass through
judge_urls untouched, in its struct.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.jaccard import shared

ORDER = 4
NGRAMS = 1 << 16
ALPHABET = 96
FOLDS = 5
REJECT_AT = 0.5
REJECT_WORDS = ("casino", "bets", "poker", "pills", "viagra", "adult", "porn", "xxx", "spam", "ads", "track", "tracker", "tracking", "loan", "loans", "cheap")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# Where no rules are given; the registered query gives its own (queries.URL_RULES).
RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("block", "net", "/de/"), Rule("allow", "example.net", "/de/8"), Rule("block", "org", "/es/"))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits: struct of rule and verdict, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _text(host: Column, path: Column) -> Column:
    """What the models read: start marks, host, path, end mark."""
    return F.concat(F.lit("\x02" * ORDER), host, path, F.lit("\x03"))


def _windows(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text) - ORDER), lambda i: F.substring(text, i, F.lit(ORDER + 1)))


def _grams(texts: DataFrame) -> DataFrame:
    """All n-grams up to ORDER + 1 characters: gram, n0 and n1 (times in accepted and rejected), places (in distinct texts).

    texts: text, rejected (0 or 1), copies, held (not counted for a model)."""
    counts = [F.sum(F.when((F.col("rejected") == side) & ~F.col("held"), F.col("copies")).otherwise(0)).alias(f"n{side}") for side in (0, 1)]
    windows = texts.select("rejected", "held", "copies", F.explode(_windows(F.col("text"))).alias("window")).groupBy("window").agg(*counts, F.count("*").alias("places"))
    ends = F.transform(F.sequence(F.lit(1), F.lit(ORDER + 1)), lambda k: F.substring(F.col("window"), ORDER + 2 - k, k))
    return windows.select(F.explode(ends).alias("gram"), "n0", "n1", "places").groupBy("gram").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "places")))


def _ratios(grams: DataFrame) -> DataFrame:
    """log p(accepted) - log p(rejected) of each window's last character: window, ratio, places.

    p(c | k characters) = (n(them and c) + kinds * p(c | k - 1 characters)) / (n(them) + kinds)"""
    context = Window.partitionBy(F.substring(F.col("gram"), F.lit(1), F.length("gram") - 1))
    seen = [F.sum(f"n{side}").over(context).alias(f"seen{side}") for side in (0, 1)]
    kinds = [F.count(F.when(F.col(f"n{side}") > 0, 1)).over(context).alias(f"kinds{side}") for side in (0, 1)]
    known = shared(grams.select("*", *seen, *kinds))

    def p(side: int, lower: Column) -> Column:
        n, seen, kinds = (F.col(f"{x}{side}") for x in ("n", "seen", "kinds"))
        return F.when(seen > 0, (n + kinds * lower) / (seen + kinds)).otherwise(lower).alias(f"p{side}")

    out = None
    for k in range(ORDER + 1):
        mine = known.filter(F.length("gram") == k + 1)
        lower = [F.lit(1.0 / ALPHABET)] * 2
        if out is not None:
            mine = mine.withColumn("end", F.substring("gram", 2, k)).join(out.select(F.col("gram").alias("end"), F.col("p0").alias("q0"), F.col("p1").alias("q1")), "end")
            lower = [F.col("q0"), F.col("q1")]
        out = mine.select("gram", "places", *(p(side, lower[side]) for side in (0, 1)))
    return out.select(F.col("gram").alias("window"), F.log(F.col("p0") / F.col("p1")).alias("ratio"), "places")


def _scored(texts: DataFrame, ratios: DataFrame, places: int) -> DataFrame:
    """texts with score: mean over the characters of log p(accepted) - log p(rejected). texts: id, text, ..."""
    heavy = F.col("places") * NGRAMS >= places
    found = texts.select("id", F.explode(_windows(F.col("text"))).alias("window")).join(F.broadcast(ratios.filter(heavy).select("window", "ratio")), "window", "left")
    light = found.filter("ratio is null").select("id", "window").join(ratios.filter(~heavy).select("window", "ratio"), "window")
    sums = [x.groupBy("id").agg(F.sum("ratio").alias("ratio")) for x in (found.filter("ratio is not null"), light)]
    total = sums[0].unionAll(sums[1]).groupBy("id").agg(F.sum("ratio").alias("ratio"))
    return texts.join(total, "id").select("text", "rejected", "held", "copies", (F.col("ratio") / (F.length("text") - ORDER)).alias("score"))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, reject_words: tuple[str, ...] = REJECT_WORDS, reject_at: float = REJECT_AT, column: str = "url") -> DataFrame:
    """pages as the struct `row`, with host, path, rule, verdict, score and p_reject (null without a model)."""
    rows = pages.select(F.struct("*").alias("row"))
    url = F.col(f"row.`{column}`")
    rows = rows.select("row", host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("decided"))
    # a host's fold depends on the host alone, so the models know nothing of the held-out hosts
    words = F.arrays_overlap(F.split("host", "[.-]"), F.array(*map(F.lit, reject_words))) if reject_words else F.lit(False)
    rows = rows.select("*", F.when(F.col("host") != "", _text(F.col("host"), F.col("path"))).alias("text"), words.cast("int").alias("rejected"), (F.pmod(F.xxhash64("host"), F.lit(FOLDS)) == 0).alias("held"))
    texts = rows.filter("text is not null").groupBy("text", "rejected", "held").agg(F.count("*").alias("copies"))
    texts = shared(texts.withColumn("id", F.monotonically_increasing_id()))
    sides = {(r["rejected"], r["held"]): r["n"] for r in texts.groupBy("rejected", "held").agg(F.sum("copies").alias("n")).collect()}
    verdict = F.lit("allow")
    score = probability = F.lit(None).cast("double")
    if {side for side, _ in sides} == {0, 1}:
        apart = len(sides) == 4
        grams = shared(_grams(texts if apart else texts.withColumn("held", F.lit(False))))
        places = grams.filter(F.length("gram") == ORDER + 1).agg(F.sum("places")).first()[0]
        scores = shared(_scored(texts, shared(_ratios(grams)), places))
        judged = scores.filter("held") if apart else scores
        mean = F.sum(F.col("copies") * F.col("score")) / F.sum("copies")
        means = {r["rejected"]: r for r in judged.groupBy("rejected").agg(F.sum("copies").alias("n"), mean.alias("mean")).collect()}
        off = F.col("score") - F.when(F.col("rejected") == 1, means[1]["mean"]).otherwise(means[0]["mean"])
        pooled = max(1e-6, judged.agg(F.sum(F.col("copies") * off * off)).first()[0] / (means[0]["n"] + means[1]["n"]))
        slope = (means[1]["mean"] - means[0]["mean"]) / pooled
        middle = (means[1]["mean"] + means[0]["mean"]) / 2
        prior = math.log(means[1]["n"] / means[0]["n"])
        # no rows of one key: those without a text aren't joined
        bare = rows.filter("text is null").withColumn("score", F.lit(None).cast("double"))
        rows = rows.filter("text is not null").join(scores.select("text", "score"), "text").select(*bare.columns).unionAll(bare)
        score = F.col("score")
        probability = 1 / (1 + F.exp(-slope * (score - middle) - prior))
        verdict = F.when(probability >= reject_at, "block").otherwise("allow")
    return rows.select("row", "host", "path", F.col("decided.rule").alias("rule"), F.coalesce("decided.verdict", verdict).alias("verdict"), score.alias("score"), probability.alias("p_reject"))
