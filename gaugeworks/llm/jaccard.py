"""N-gram Jaccard join with set-relation skipping: which texts link, and the groups that links form.

A text's set holds its distinct SHINGLE-word shingles. Two texts link when their sets have a Jaccard similarity of
PERCENT or more. The result is exact, at any group size, without a row for each pair of a group:

1. Equal sets become one class; classes, not texts, are joined.
2. Each class posts the first tokens of its set in one global order, rarest first: by how common a shingle's words
   are, and the HEAVY most frequent shingles last. Classes that link share l(n) = 1 + n // EXTRA of the first
   n - ceil(t n) + l(n) tokens. Lists of one class are dropped.
3. Highly similar sets: in each list and size band, classes are compared with the band's first one, a star and not all
   pairs, and each class with the centre that it meets most. Links make clusters; similarities of LOOSE or more make
   families, each of one cluster or more.
4. What is known of a similar set answers for the others: classes of a cluster are not compared again. Lists are cut
   into blocks, one for each family; two blocks are skipped together when the positions of the token in them, or the
   sizes, leave no overlap that could reach the threshold. Families whose blocks meet on enough lists are opened.
5. What is left to compare is, for each family, the classes outside of its largest cluster, and those of smaller
   families opened with it, against that cluster and each other. Blocks of at most BLOCK tokens a side go to tasks,
   which count common tokens by an index of one side and report a spanning forest of the links they find.
6. Groups are the connected components of all links, by alternating large and small stars; FEW links or less are joined
   in the driver.

Shingles are 64-bit hashes; a set is known by its size and two 64-bit sums of its hashes. The order, and so HEAVY, has
no effect on the result. Sets are made again from the texts where they are compared; a filter of fixed width (BITS)
spares the texts that no comparison needs. Where rows look up what holds for their class or list, keys with a MANY-th of the
rows or more (MANY at most) are answered from a broadcast table, so a group with a third of all rows meets in no task.

Defined cases: a text with fewer than SHINGLE words has its whole sequence as the one shingle; null and empty texts and
those without words have no shingles and link with nothing; very long texts count whole; repeated rows are copies; rows with
one id and different texts count as one document that links as either does; rows with a null id are documents of their own,
which link others too, and get their group's smallest id, or null if there is none (their places are numbered after the
largest id, which must be below 2**62, else they take part only where another row has their text); an empty table gives no
rows; keep_one keeps one row for each group, also of repeated rows and null ids, and passes other columns through, whatever
their names.
"""

from __future__ import annotations

import functools
import gc
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.features import Chunk, chunks, mix
from gaugeworks.sources.scratch import settled

SHINGLE = 5
PERCENT = 75
EXTRA = 32
HEAVY = 1 << 16
LOCAL = 3
BITS = 23
MARKS = 20
LOOSE = 40
BLOCK = 500_000
MANY = 1024
FEW = 1 << 16
_LOCAL = re.compile(r"local(\[|$)")  # threads of the driver; local-cluster[...] has executors of its own


def tidied(frame: DataFrame) -> DataFrame:
    """The frame; shuffles and checkpoints that nothing refers to any more leave the executors' disks, as the driver's garbage is collected."""
    context = frame.sparkSession.sparkContext
    if not _LOCAL.match(context.master):
        gc.collect()
        context._jvm.System.gc()
    return frame


def shared(frame: DataFrame) -> DataFrame:
    """A reliable checkpoint, in the cluster's shared folder."""
    return settled(tidied(frame))


def light(frame: DataFrame, like: DataFrame) -> DataFrame:
    """The frame, broadcast where it is joined if `like`, which is settled and has at least its rows, has FEW rows or less."""
    return F.broadcast(frame) if like.count() <= FEW else frame


def shingle_sets(chunk: Chunk, n: int = SHINGLE, common: np.ndarray | None = None) -> Iterator[np.ndarray | tuple[np.ndarray, np.ndarray]]:
    """The sorted distinct hashes of each text; with `common` (see Order) also how common their words are."""
    words = chunk.words(lower=True)
    out, text = words.grams(n)
    edges = np.searchsorted(text, np.arange(len(chunk) + 1))
    if common is not None:
        total = np.append(0, np.cumsum(common[(words.hash >> np.uint64(64 - MARKS)).astype(np.int64)], dtype=np.int64))
        level = total[n:] - total[: max(0, len(total) - n)]
        owner = words.text
        level = level[owner[: len(level)] == owner[n - 1 :]] if len(level) else level
    for i in range(len(chunk)):
        if edges[i] < edges[i + 1]:
            mine = out[edges[i] : edges[i + 1]]
            if common is None:
                yield np.unique(mine)
            else:
                found, first = np.unique(mine, return_index=True)
                yield found, level[edges[i] : edges[i + 1]][first]
            continue
        few = words.hash[words.edges[i] : words.edges[i + 1]]
        whole = np.zeros(1, np.uint64)
        for h in few:
            whole = whole * np.uint64(0xD1342543DE82EF95) + h
        found = mix(whole + np.uint64(len(few))) if len(few) else np.empty(0, np.uint64)
        yield found if common is None else (found, np.zeros(len(found), np.int64))


@dataclass(frozen=True)
class Order:
    """The global order of shingles: the HEAVY most frequent last, by count; before them by how common their words are
    (a power of two for each word, by table of its hash), then by hash."""

    tokens: np.ndarray
    counts: np.ndarray
    common: np.ndarray

    def first(self, found: np.ndarray, level: np.ndarray, keep: int) -> tuple[np.ndarray, int]:
        """The first `keep` in this order, and how many of them are in `tokens`."""
        marks = self.marks
        rank = level.copy()
        maybe = np.flatnonzero(marks[(found >> np.uint64(64 - MARKS)).astype(np.int64)])
        if len(maybe):
            place = np.minimum(np.searchsorted(self.tokens, found[maybe]), len(self.tokens) - 1)
            sure = self.tokens[place] == found[maybe]
            rank[maybe[sure]] = (1 << 32) + self.counts[place[sure]]
        places = np.argsort(rank, kind="stable")[:keep]
        return found[places], int((rank[places] >= 1 << 32).sum())

    @functools.cached_property
    def marks(self) -> np.ndarray:
        out = np.zeros(1 << MARKS, bool)
        out[(self.tokens >> np.uint64(64 - MARKS)).astype(np.int64)] = True
        return out


def least_overlap(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def extra(n: int) -> int:
    """l(n): the common tokens that two linked sets have in what they post, for the smaller of both sizes."""
    return 1 + n // EXTRA


class _Counts:
    """Counts of hashes; now and then those seen once go, so that memory stays bounded."""

    def __init__(self) -> None:
        self.keys, self.counts, self.waiting, self.held = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0

    def add(self, found: np.ndarray) -> None:
        self.waiting.append(found)
        self.held += len(found)
        if self.held > 1 << 20:
            self.merge(1)

    def merge(self, least: int) -> None:
        new, n_new = np.unique(np.concatenate([np.empty(0, np.uint64), *self.waiting]), return_counts=True)
        self.waiting, self.held = [], 0
        keys, place = np.unique(np.concatenate([self.keys, new]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([self.counts, n_new]), len(keys)).astype(np.int64)
        if least > 1 or len(keys) > 16 * HEAVY:
            keep = np.flatnonzero(counts >= max(least, 2))
            keep = np.sort(keep[np.argsort(-counts[keep], kind="stable")[:HEAVY]])
            keys, counts = keys[keep], counts[keep]
        self.keys, self.counts = keys, counts


def global_order(documents: DataFrame, n: int) -> Order:
    """From all documents. Each task sums up its own texts and reports at most HEAVY shingles and words that it has
    seen LOCAL times; of all reports the HEAVY with the highest sums come to the driver, so what is broadcast is bounded."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, words = _Counts(), _Counts()
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                for s in shingle_sets(chunk, n):
                    shingles.add(s)
                words.add(chunk.words(lower=True).hash)
        for kind, x in enumerate((shingles, words)):
            x.merge(LOCAL)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x.keys), kind, np.int32)), pa.array(x.keys.view(np.int64)), pa.array(x.counts)], ["kind", "token", "n"])

    found = shared(documents.select("text").mapInArrow(count, "kind int, token long, n long").groupBy("kind", "token").agg(F.sum("n").alias("n")))
    tops = []
    for kind in (0, 1):
        top = found.filter(F.col("kind") == kind).orderBy(F.desc("n"), "token").limit(HEAVY).select("token", "n").toArrow()
        tokens = top.column("token").to_numpy().view(np.uint64)
        order = np.argsort(tokens)
        tops.append((tokens[order], top.column("n").to_numpy()[order]))
    common = np.zeros(1 << MARKS, np.uint8)
    np.maximum.at(common, (tops[1][0] >> np.uint64(64 - MARKS)).astype(np.int64), np.log2(np.maximum(tops[1][1], 1)).astype(np.uint8))
    return Order(*tops[0], common)


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], total: int) -> DataFrame:
    """rows with the columns of table's row of the same key, or nulls. table: on, copies (rows of the key), values; total: rows.

    A key with a MANY-th of the rows is answered by broadcast; its rows are then spread over the other join."""
    values = [c for c in table.columns if c not in (*on, "copies")]
    many = F.col("copies") * MANY >= total
    first = rows.join(F.broadcast(table.filter(many).select(*on, F.struct(*values).alias("__first"))), on, "left")
    rest = table.filter(~many).select(*on, F.struct(*values).alias("__rest"), F.lit(-1).cast("bigint").alias("__apart"))
    apart = F.when(F.col("__first").isNull(), F.lit(-1)).otherwise(F.monotonically_increasing_id())
    found = first.withColumn("__apart", apart).join(rest, [*on, "__apart"], "left").withColumn("__first", F.coalesce("__first", "__rest"))
    return found.select(*rows.columns, *(F.col(f"__first.{v}").alias(v) for v in values))


def prefixes(documents: DataFrame, order: Order, n: int, percent: int) -> DataFrame:
    """doc_id, n, a, b (the set's sums), prefix: the first tokens of the set, rarest first; hot: how many of them, the
    last ones, are among the order's most frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, a, b, lists, hot = [], [], [], [], []
            for chunk in chunks(batch.column("text")):
                for s, level in shingle_sets(chunk, n, order.common):
                    sizes.append(len(s))
                    a.append(int(mix(s).sum(dtype=np.uint64)) if len(s) else 0)
                    b.append(int(np.bitwise_xor.reduce(s)) if len(s) else 0)
                    keep = len(s) - least_overlap(len(s), percent) + extra(len(s)) if len(s) else 0
                    found, frequent = order.first(s, level, keep)
                    lists.append(found.view(np.int64))
                    hot.append(frequent)
            offsets = np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int32)
            prefix = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(lists) if lists else np.empty(0, np.int64)))
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int32()), pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64)), prefix, pa.array(hot, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "a", "b", "prefix", "hot"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n int, a long, b long, prefix array<long>, hot int")


def _bit(node: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(node), 64 - BITS)


def sets_of(documents: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """doc_id and set, for the nodes (column `node`); some other documents may be among them."""
    words = nodes.select(_bit(F.col("node")).alias("bit")).groupBy(F.shiftright("bit", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("bits"))
    flags = np.zeros(1 << (BITS - 5), np.uint32)
    for r in words.collect():
        flags[r["word"]] = r["bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column("bit").to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((flags[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1 == 1))
            lists = [s.view(np.int64) for chunk in chunks(batch.column("text")) for s in shingle_sets(chunk, n)]
            offsets = np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int32)
            values = pa.array(np.concatenate(lists) if lists else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "set"])

    rows = documents.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.select("doc_id", "text", _bit(F.col("doc_id")).alias("bit")).mapInArrow(run, "doc_id long, set array<long>")


def compared(pairs: DataFrame, documents: DataFrame, n: int, least: int) -> DataFrame:
    """The pairs (x, y) with at least `least` percent similarity, and their sizes: x, y, common, every."""
    nodes = pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    sets = shared(sets_of(documents, nodes, n))
    both = pairs.join(sets.select(F.col("doc_id").alias("x"), F.col("set").alias("one")), "x")
    both = both.join(sets.select(F.col("doc_id").alias("y"), F.col("set").alias("two")), "y")
    sizes = both.select("x", "y", F.size(F.array_intersect("one", "two")).alias("common"), (F.size("one") + F.size("two")).alias("sum"))
    return sizes.select("x", "y", "common", (F.col("sum") - F.col("common")).alias("every")).filter(f"100 * common >= {least} * every")


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _joined(x: np.ndarray, y: np.ndarray) -> pa.Table:
    """node and root of components, by union-find."""
    ids, place = np.unique(np.concatenate([x, y]), return_inverse=True)
    parent = list(range(len(ids)))
    for i, j in zip(place[: len(x)].tolist(), place[len(x) :].tolist(), strict=True):
        a, b = _root(parent, i), _root(parent, j)
        parent[max(a, b)] = min(a, b)
    root = np.array([_root(parent, i) for i in range(len(ids))], np.int64)
    under = np.flatnonzero(root != np.arange(len(ids)))
    return pa.table({"node": pa.array(ids[under], pa.int64()), "root": pa.array(ids[root[under]], pa.int64())})


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node that edges (x, y) reach, for every node of an edge but the roots.

    At most FEW edges are joined in the driver, and the result is broadcast; the edges are read twice, so they should be settled."""

    def stats(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())

    edges = edges.filter("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
    if edges.count() <= FEW:
        few = edges.toArrow()
        return F.broadcast(edges.sparkSession.createDataFrame(_joined(few.column("x").to_numpy(), few.column("y").to_numpy())))
    now = shared(edges.distinct())
    before, is_now = None, stats(now)
    while is_now != before:
        # x is the larger one, so the smallest neighbour of a node is that of its edges as x, or the node itself if it has none
        low = now.groupBy("x").agg(F.min("y").alias("low"))
        lower = low.select(F.col("x").alias("y"), F.col("low").alias("lower"))
        large = now.join(lower, "y", "left").select("x", F.coalesce("lower", "y").alias("y")).unionAll(low.select("x", F.col("low").alias("y"))).distinct()
        low = large.groupBy("x").agg(F.min("y").alias("low"))
        small = large.join(low, "x").filter("y <> low").select(F.col("y").alias("x"), F.col("low").alias("y")).unionAll(low.select("x", F.col("low").alias("y")))
        now = shared(small.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).filter("x <> y").distinct())
        before, is_now = is_now, stats(now)
    return now.select(F.col("x").alias("node"), F.col("y").alias("root"))


def _postings(classes: DataFrame) -> DataFrame:
    """token, node, n, at (its place in the prefix), hot, in lists of two classes or more.

    The order's most frequent tokens (hot) are taken to have such lists, which are not gathered to find out."""
    every = classes.select("node", "n", (F.size("prefix") - F.col("hot")).alias("cold"), F.posexplode("prefix").alias("at", "token")).select("token", "node", "n", "at", (F.col("at") >= F.col("cold")).alias("hot"))
    w = Window.partitionBy("token").orderBy("node")
    met = every.filter("not hot").withColumns({"one": F.lag("node").over(w), "two": F.lead("node").over(w)})
    return met.filter("one is not null or two is not null").select(*every.columns).unionAll(every.filter("hot"))


def _stars(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of a class and the first one in its lists' size band."""
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) * 2).cast("int")
    w = Window.partitionBy("token", "band").orderBy("node")
    banded = postings.withColumn("band", band)
    hot = banded.filter("hot")
    firsts = shared(hot.groupBy("token", "band").agg(F.min("node").alias("y"), F.count("*").alias("copies")))
    total = firsts.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()["n"]
    hot = looked_up(hot, firsts, ["token", "band"], total)
    found = banded.filter("not hot").withColumn("y", F.first("node").over(w)).unionByName(hot).filter("node <> y")
    # pairs that meet by chance on a list or two aren't worth a comparison; if one links, its families are opened
    pairs = found.groupBy(F.col("node").alias("x"), "y").agg(F.count("*").alias("met"), F.first("n").alias("n")).filter(f"2 * met >= 1 + n div {EXTRA}")
    return pairs.groupBy("x").agg(F.max(F.struct("met", (-F.col("y")).alias("y"))).alias("best")).select("x", (-F.col("best.y")).alias("y"))


def _opened(postings: DataFrame, families: DataFrame, percent: int) -> DataFrame:
    """Families (one, two) that share enough tokens. families: node, root, for all nodes that aren't their family's first."""
    named = postings.join(families, "node", "left").withColumn("family", F.coalesce("root", "node"))
    blocks = named.groupBy("token", "family").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("at").alias("at"), F.max(F.col("n") - F.col("at")).alias("rest"))
    sides = [blocks.select("token", *(F.col(c).alias(f"{c}{i}") for c in ("family", "low", "high", "at", "rest"))) for i in (1, 2)]
    overlap = F.least("at1", "at2") + F.least("rest1", "rest2")
    meet = sides[0].join(sides[1], "token").filter(f"family1 < family2 and 100 * high1 >= {percent} * low2 and 100 * high2 >= {percent} * low1")
    meet = meet.filter((100 + percent) * overlap >= percent * (F.col("low1") + F.col("low2")))
    few = F.least(F.min("low1"), F.min("low2")).alias("n")
    return meet.groupBy(F.col("family1").alias("one"), F.col("family2").alias("two")).agg(F.count("*").alias("met"), few).filter(f"met >= 1 + n div {EXTRA}").select("one", "two")


def _tasks(members: DataFrame, opened: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (x, y) of families of one class; and rows (task, other, node) of what is to be compared in blocks.

    members: node, n, cluster, family."""
    clusters = members.groupBy("family", "cluster").agg(F.count("*").alias("size"), F.sum("n").alias("tokens"))
    main = F.max(F.struct("size", (-F.col("cluster")).alias("cluster"), "tokens"))
    families = clusters.groupBy("family").agg(F.sum("size").alias("size"), main.alias("main")).select("family", "size", (-F.col("main.cluster")).alias("main"), F.col("main.tokens").alias("main_tokens"))
    several = shared(families.filter("size > 1"))
    families = light(several, several)
    side = lambda i, name: families.select(F.col("family").alias(name), F.col("size").alias(f"size{i}"))
    sized = opened.join(side(1, "one"), "one", "left").join(side(2, "two"), "two", "left").fillna(1, ["size1", "size2"])
    alone = sized.filter("size1 = 1 and size2 = 1").select(F.col("one").alias("x"), F.col("two").alias("y"))
    first = F.expr("size1 > size2 or (size1 = size2 and one < two)")
    guests = sized.filter("size1 > 1 or size2 > 1").select(F.when(first, F.col("one")).otherwise(F.col("two")).alias("host"), F.when(first, F.col("two")).otherwise(F.col("one")).alias("family"))
    guests = light(guests, opened).join(members.select("family", "node", "n"), "family").select(F.col("host").alias("family"), "node", "n")
    homes = members.join(families.select("family", "main"), "family")
    others = homes.filter("cluster <> main").select("family", "node", "n").unionByName(guests)
    others = shared(others)
    hosts = others.groupBy("family").agg(F.sum("n").alias("other_tokens")).join(families.select("family", "main", "main_tokens"), "family")
    parts = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    hosts = light(hosts.select("family", "main", parts("other_tokens").alias("others"), parts("main_tokens").alias("mains")), several)
    deal = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    task = lambda kind, i, j: F.struct("family", F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    guests = others.join(hosts, "family").withColumn("mine", deal(F.col("others")))
    against_main = F.transform(every(F.col("mains")), lambda j: F.struct(task("main", F.col("mine"), j).alias("task"), F.lit(True).alias("other")))
    among = F.transform(every(F.col("others")), lambda j: F.struct(task("other", F.least(F.col("mine"), j), F.greatest(F.col("mine"), j)).alias("task"), (F.col("mine") <= j).alias("other")))
    rows = guests.select("node", F.explode(F.concat(against_main, among)).alias("t"))
    hosted = members.join(hosts.withColumnRenamed("main", "cluster"), ["family", "cluster"]).withColumn("mine", deal(F.col("mains")))
    mains = hosted.select("node", F.explode(F.transform(every(F.col("others")), lambda i: F.struct(task("main", i, F.col("mine")).alias("task"), F.lit(False).alias("other")))).alias("t"))
    return alone, rows.unionByName(mains).select(F.xxhash64("t.task").alias("place"), F.to_json("t.task").alias("task"), "t.other", "node")


def _forest(one: list[tuple[int, np.ndarray]], two: list[tuple[int, np.ndarray]], percent: int, apart: bool) -> list[tuple[int, int]]:
    """Links between the sets of `one` and `two`, as a spanning forest; `apart`: not within `two`."""
    rows = [*two, *one] if apart else one
    if len(rows) < 2:
        return []
    nodes = [r[0] for r in rows]
    size = np.array([len(r[1]) for r in rows])
    tokens, place = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), size)
    indexed = len(two) if apart else len(rows)  # only these rows are in the index
    inside = owner < indexed
    order = np.argsort(place[inside], kind="stable")
    lists = owner[inside][order]
    starts = np.searchsorted(place[inside][order], np.arange(len(tokens) + 1))
    edges = np.append(0, np.cumsum(size))
    parent, out = list(range(len(rows))), []
    for i in range(len(two) if apart else 0, len(rows)):
        mine = place[edges[i] : edges[i + 1]]
        n = starts[mine + 1] - starts[mine]
        found = lists[np.arange(n.sum()) + np.repeat(starts[mine] - np.append(0, np.cumsum(n)[:-1]), n)]
        common = np.bincount(found, minlength=indexed)
        for j in np.flatnonzero(100 * common >= percent * (size[i] + size[:indexed] - common)).tolist():
            a, b = _root(parent, i), _root(parent, j)
            if a != b:
                parent[a] = b
                out.append((max(nodes[i], nodes[j]), min(nodes[i], nodes[j])))
    return out


def _block_links(tasks: DataFrame, documents: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (x, y) that the tasks find."""
    sets = sets_of(documents, tasks.select("node").distinct(), n)
    rows = tasks.join(sets, F.col("node") == F.col("doc_id")).select("place", "task", "other", "node", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, ([], [])

        def done() -> pa.RecordBatch:
            apart = bool(sides[0]) and bool(sides[1])
            links = _forest(sides[1], sides[0], percent, apart) if sides[1] else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["x", "y"])

        for batch in batches:
            found = batch.column("set")
            edges, values = found.offsets.to_numpy(), found.values.to_numpy()
            for k, (task, other, node) in enumerate(zip(batch.column("task").to_pylist(), batch.column("other").to_pylist(), batch.column("node").to_pylist(), strict=True)):
                if task != now:
                    if now is not None:
                        yield done()
                    now, sides = task, ([], [])
                sides[other].append((node, values[edges[k] : edges[k + 1]].copy()))
        if now is not None:
            yield done()

    return rows.repartition("place").sortWithinPartitions("place", "task").select("task", "other", "node", "set").mapInArrow(run, "x long, y long")


def _numbered(documents: DataFrame) -> tuple[DataFrame, int]:
    """documents with a column `id`: doc_id, or for rows without one a number above the largest id, which is the second result.

    Rows without an id are written once, so that they keep their numbers whenever the texts are read again."""
    found = documents.agg(F.max(F.col("doc_id").cast("long")).alias("top"), F.count_if(F.col("doc_id").isNull()).alias("bare")).first()
    top = -1 if found["top"] is None else found["top"]
    named = documents.withColumn("id", F.col("doc_id").cast("long"))
    if not found["bare"] or top >= 1 << 62:
        return named, top
    bare = documents.filter("doc_id is null").withColumn("id", F.lit(top + 1) + F.monotonically_increasing_id())
    return named.filter("doc_id is not null").unionByName(shared(bare)), top


def _same(texts: DataFrame, ids: DataFrame) -> DataFrame | None:
    """Links (x, y) of classes that hold texts of one id, as rows that share an id but no text are one document; None if there
    are no such rows. texts: doc_id, n, a, b; ids: n, a, b, node."""
    ends = texts.groupBy("doc_id").agg(*(f(F.struct("n", "a", "b")).alias(c) for f, c in ((F.min, "low"), (F.max, "high"))))
    several = shared(ends.filter("low <> high").select("doc_id"))
    if several.isEmpty():
        return None
    held = shared(texts.join(several, "doc_id").distinct().join(ids, ["n", "a", "b"]).select("doc_id", "node").distinct())
    links = held.join(held.groupBy("doc_id").agg(F.min("node").alias("y")), "doc_id")
    return shared(links.filter("node <> y").select(F.col("node").alias("x"), "y"))


def _components(documents: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n, component, a row for each of documents (doc_id, text)."""
    base = shared(prefixes(documents, global_order(documents, n), n, percent))
    total = base.count()
    classes = base.filter("n > 0").groupBy("n", "a", "b").agg(F.min("doc_id").alias("node"), F.first("prefix").alias("prefix"), F.first("hot").alias("hot")).filter("node is not null")
    postings = shared(_postings(classes))
    base = shared(base.drop("prefix", "hot"))
    del classes
    ids = shared(base.filter("n > 0").groupBy("n", "a", "b").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")))
    same = _same(base.filter("n > 0 and doc_id is not null").select("doc_id", "n", "a", "b"), ids)
    stars = shared(compared(shared(_stars(postings, percent)), documents, n, LOOSE))
    tight, loose = stars.filter(f"100 * common >= {percent} * every").select("x", "y"), stars.select("x", "y")
    if same is not None:
        tight, loose = tight.unionByName(same), loose.unionByName(same)
    clusters, families = components(tight), components(loose)
    members = ids.filter("node is not null").select("node", "n")
    members = members if same is None else members.distinct()
    members = members.join(clusters.withColumnRenamed("root", "cluster"), "node", "left").join(families.withColumnRenamed("root", "family"), "node", "left")
    members = shared(members.select("node", "n", F.coalesce("cluster", "node").alias("cluster"), F.coalesce("family", "node").alias("family")))
    alone, tasks = _tasks(members, shared(_opened(postings, families, percent)))
    more = shared(compared(shared(alone), documents, n, percent).select("x", "y"))
    blocks = shared(_block_links(shared(tasks), documents, n, percent))
    roots = components(tight.unionByName(more).unionByName(blocks))
    answers = shared(ids.join(roots, "node", "left").select("n", "a", "b", F.coalesce("root", "node").alias("root"), "copies"))
    named = looked_up(base.filter("n > 0"), answers, ["n", "a", "b"], total).select("doc_id", "n", "root")
    named = named.unionAll(base.filter("n = 0").select("doc_id", "n", F.lit(None).cast("bigint").alias("root")))
    return named.select("doc_id", "n", F.coalesce("root", "doc_id").alias("component"))


def groups(documents: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id. documents: doc_id, text."""
    rows, top = _numbered(documents.select("doc_id", "text"))
    found = _components(rows.select(F.col("id").alias("doc_id"), "text"), n, percent)
    given = lambda c: F.when(F.col(c) <= top, F.col(c))
    return tidied(found).select(given("doc_id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), given("component").alias("component_id"))


def keep_one(documents: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each group, with its columns: that with the smallest id; of rows with one id, that with the smallest
    hash of the text."""
    rows, _ = _numbered(documents.select("doc_id", "text", F.struct("*").alias("row")))
    rows = rows.select(F.col("id").alias("doc_id"), "text", "row")
    found = shared(_components(rows.select("doc_id", "text"), n, percent))
    kept = found.filter("doc_id = component").groupBy(F.col("doc_id").alias("kept")).agg(F.count("*").alias("rows"))
    out = rows.join(kept, F.col("doc_id") == F.col("kept"))
    several = out.filter("rows > 1").groupBy("kept").agg(F.min_by("row", F.xxhash64("text")).alias("row"))
    return out.filter("rows = 1").select("row").unionAll(several.select("row")).select("row.*")


def oracle(n: int = SHINGLE, percent: int = PERCENT) -> str:
    """DuckDB SQL for groups over documents with distinct ids, none null: every pair that shares a shingle, then all paths."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + {n - 1}], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, 1 + greatest(len(words) - {n - 1}, least(len(words), 1)))) AS i FROM w)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN c a ON a.doc_id = x JOIN c b ON b.doc_id = y WHERE 100 * common >= {percent} * (a.n + b.n - common)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT w.doc_id, CAST(coalesce(any_value(c.n), 0) AS BIGINT) AS n_shingles, CAST(least(w.doc_id, min(r.y)) AS BIGINT) AS component_id FROM w LEFT JOIN c USING (doc_id) LEFT JOIN r ON r.x = w.doc_id GROUP BY w.doc_id"""
