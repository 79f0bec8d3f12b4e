"""Benchmark decontamination: BM25 retrieval of test items for every training passage by block-max WAND, then overlap.

Test items, cut into entries of at most ENTRY words that begin every STEP words, form an inverted index: for each term its postings (entry, impact),
and for each term and block of BLOCK entries the largest impact. An impact is a term's BM25 weight divided by the sum of
its entry's, so that an entry scores 1 against a passage that holds all of it. Passages are windows of WINDOW words,
beginning every STRIDE words, over the whole text, so any run of ENTRY words lies in one of them. The block maxima give
the bound of every (passage, block) of a batch at once; blocks whose bound is below THRESHOLD are skipped, the others
are walked by WAND's pivots with full scores. Every entry at or above the threshold is then verified: the shares of its
question's and of its answer's word n-grams that the passage holds must both reach their limits. The answer is the last
quarter of the words, three at least: of an entry, so that any run of ENTRY words of an item is found wherever it begins,
and for an item of several entries also of the whole item, held against all retrieved passages of the document together.

Words are runs without white space and ASCII punctuation, lower-cased. The index goes to the tasks in slices of
about SLICE entries, however many items there are and however long; each slice is one pass over the documents. Term weights are those
of all items: how many hold a term is counted on the cluster, and a slice collects the counts of its own terms. All texts of one item
are in one slice, so slices change no result.

Defined cases: null and empty texts have no passages; very long ones have all of theirs; items with a null id or text, or
without words, match nothing; equal items are all reported, and of several texts of one item the best hit; without items,
or in an empty table, nothing is leaked; of passages with one score the first counts; repeated rows each get theirs; other
columns pass through decontaminate untouched, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.features import PUNCTUATION, Words, chunks, mix
from gaugeworks.llm.jaccard import shared

ENTRY = 64
STEP = 16
WINDOW = 128
STRIDE = 64
BLOCK = 4
SLICE = 50_000
THRESHOLD = 0.5
QUESTION_GRAM, ANSWER_GRAM = 5, 3
QUESTION, ANSWER = 0.5, 0.5
K1, B = 1.2, 0.75
CELLS = 4_000_000
HITS = "doc_id long, item_id long, passage long, score double, question_overlap double, answer_overlap double"


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of the n-word windows; of the whole, if it is shorter."""
    n = max(1, min(n, len(words)))
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD1342543DE82EF95) + words[k : k + len(out)]
    return np.unique(mix(out))


def parts_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Question and answer."""
    k = min(len(words), max(3, len(words) // 4))
    return words[: len(words) - k], words[len(words) - k :]


@dataclass
class Index:
    """Terms are numbers: places in `vocabulary`, the sorted word hashes."""

    items: np.ndarray  # item of each entry
    parts: list[tuple[np.ndarray, np.ndarray]]  # words of its question and answer
    whole: list[int]  # place in `wholes` of each entry's item, -1 if the entry is the item
    wholes: list[tuple[np.ndarray, np.ndarray]]  # questions and answers of the items of several entries
    vocabulary: np.ndarray
    term_start: np.ndarray  # postings of term t: term_start[t] to term_start[t + 1]
    entries: np.ndarray
    impacts: np.ndarray
    block_start: np.ndarray
    blocks: np.ndarray
    block_most: np.ndarray

    @property
    def n_blocks(self) -> int:
        return -(-len(self.items) // BLOCK)


@dataclass(frozen=True)
class Weights:
    """Of all items: how many have words, the entries' mean length, and for sorted word hashes how many items hold them."""

    items: int
    length: float
    terms: np.ndarray
    held: np.ndarray


def starts_of(n: int) -> list[int]:
    """First words of the entries of an item of n words."""
    return [*range(0, n - ENTRY, STEP), max(0, n - ENTRY)] if n else []


def build_index(rows: list[tuple[int, str | None]], weights: Weights | None = None) -> Index | None:
    """None if there are no words. Without weights the rows are all items."""
    ids, found, whole, wholes, row = [], [], [], [], []
    column = pc.utf8_lower(pa.array([x[1] for x in rows], pa.string()))
    for chunk in chunks(column):
        words = chunk.words(between=PUNCTUATION)
        for i in range(len(chunk)):
            mine = words.hash[words.edges[i] : words.edges[i + 1]]
            last = len(mine) - ENTRY
            if last > 0:
                wholes.append(parts_of(mine))
            for a in starts_of(len(mine)):
                ids.append(rows[chunk.first + i][0])
                found.append(mine[a : a + ENTRY])
                whole.append(len(wholes) - 1 if last > 0 else -1)
                row.append(chunk.first + i)
    if not found:
        return None
    pairs = [np.unique(x, return_counts=True) for x in found]
    vocabulary, term = np.unique(np.concatenate([p[0] for p in pairs]), return_inverse=True)
    entry = np.repeat(np.arange(len(found)), [len(p[0]) for p in pairs])
    count = np.concatenate([p[1] for p in pairs])
    length = np.array([len(x) for x in found])
    if weights is None:
        # an item counts once for a term, however many of its entries hold it
        held = np.bincount(np.unique(np.array(row)[entry] * len(vocabulary) + term) % len(vocabulary), minlength=len(vocabulary))
        weights = Weights(len(set(row)), length.mean(), vocabulary, held)
    held = weights.held[np.searchsorted(weights.terms, vocabulary)]
    idf = np.log(1 + (weights.items - held + 0.5) / (held + 0.5))
    weight = idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * length[entry] / weights.length))
    impact = weight / np.bincount(entry, weight)[entry]
    order = np.lexsort((entry, term))
    term, entry, impact = term[order], entry[order], impact[order]
    cell, place = np.unique(term * (len(found) + 1) + entry // BLOCK, return_inverse=True)
    block_most = np.zeros(len(cell))
    np.maximum.at(block_most, place, impact)
    block_term = cell // (len(found) + 1)
    starts = np.arange(len(vocabulary) + 1)
    parts = [parts_of(x) for x in found]
    return Index(np.array(ids, np.int64), parts, whole, wholes, vocabulary, np.searchsorted(term, starts), entry, impact, np.searchsorted(block_term, starts), cell % (len(found) + 1), block_most)


def spread(start: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each term its list: the number of the term's place in `terms`, and the places in the lists."""
    n = start[terms + 1] - start[terms]
    owner = np.repeat(np.arange(len(terms)), n)
    return owner, np.arange(len(owner)) + np.repeat(start[terms] - np.append(0, np.cumsum(n)[:-1]), n)


def walk(index: Index, terms: list[int], block: int, threshold: float) -> list[tuple[int, float]]:
    """WAND over the entries of one block: entries at or above the threshold with their scores."""
    low, high = block * BLOCK, (block + 1) * BLOCK
    cursors = []  # [entry, place, end, bound]
    for t in terms:
        a, b = int(index.term_start[t]), int(index.term_start[t + 1])
        a += int(np.searchsorted(index.entries[a:b], low))
        b = a + int(np.searchsorted(index.entries[a:b], high))
        if a < b:
            cursors.append([int(index.entries[a]), a, b, float(index.impacts[a:b].max())])
    out = []
    while cursors:
        cursors.sort()
        bound, pivot = 0.0, None
        for c in cursors:
            bound += c[3]
            if bound >= threshold - 1e-9:
                pivot = c[0]
                break
        if pivot is None:
            break
        if cursors[0][0] == pivot:
            score = sum(float(index.impacts[c[1]]) for c in cursors if c[0] == pivot)
            if score >= threshold - 1e-9:
                out.append((pivot, score))
            target = pivot + 1
        else:
            target = pivot
        for c in cursors:
            while c[1] < c[2] and index.entries[c[1]] < target:
                c[1] += 1
            c[0] = int(index.entries[c[1]]) if c[1] < c[2] else high
        cursors = [c for c in cursors if c[1] < c[2]]
    return out


def passages(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and end of each window."""
    n = np.maximum(-(-(words.counts - WINDOW) // STRIDE) + 1, (words.counts > 0).astype(int))
    text = np.repeat(np.arange(len(n)), n)
    start = (np.arange(len(text)) - np.repeat(np.append(0, np.cumsum(n)[:-1]), n)) * STRIDE + words.edges[:-1][text]
    return text, start, np.minimum(start + WINDOW, words.edges[1:][text])


def retrieve(index: Index, words: Words, threshold: float = THRESHOLD) -> Iterator[tuple[int, int, int, int, float]]:
    """Text, first word and end of a passage, entry, score, for all at or above the threshold."""
    place = np.minimum(np.searchsorted(index.vocabulary, words.hash), len(index.vocabulary) - 1)
    known = np.flatnonzero(index.vocabulary[place] == words.hash)
    term = place[known]
    text, start, end = passages(words)
    step = max(1, CELLS // index.n_blocks)
    for low in range(0, len(text), step):
        high = min(len(text), low + step)
        a, b = np.searchsorted(known, start[low:high]), np.searchsorted(known, end[low:high])
        window = np.repeat(np.arange(high - low), b - a)
        inside = np.arange(len(window)) + np.repeat(a - np.append(0, np.cumsum(b - a)[:-1]), b - a)
        size = len(index.vocabulary)
        distinct = np.unique(window * size + term[inside])
        window, mine = distinct // size, distinct % size
        owner, places = spread(index.block_start, mine)
        bounds = np.bincount(window[owner] * index.n_blocks + index.blocks[places], index.block_most[places], (high - low) * index.n_blocks)
        edges = np.searchsorted(window, np.arange(high - low + 1))
        for cell in np.flatnonzero(bounds >= threshold - 1e-9).tolist():
            w, block = divmod(cell, index.n_blocks)
            for entry, score in walk(index, mine[edges[w] : edges[w + 1]].tolist(), block, threshold):
                yield int(text[low + w]), int(start[low + w]), int(end[low + w]), entry, score


def shares(parts: tuple[np.ndarray, np.ndarray], words: Words, spans: list[tuple[int, int]]) -> list[float]:
    """The shares of question and answer that the spans hold together."""
    out = []
    for part, n in zip(parts, (QUESTION_GRAM, ANSWER_GRAM), strict=True):
        mine, n = grams(part, n), min(n, max(1, len(part)))
        out.append(float(np.isin(mine, np.concatenate([grams(words.hash[a:b], n) for a, b in spans])).mean()) if len(part) else 1.0)
    return out


def verified(index: Index, words: Words, hits: Iterator[tuple[int, int, int, int, float]]) -> dict[tuple[int, int], tuple]:
    """For each text and item: its best passage whose overlap is enough (score, minus first word; then both overlaps)."""
    out: dict[tuple[int, int], tuple] = {}
    several: dict[tuple[int, int, int], dict[tuple[int, int], float]] = {}  # by text, whole, item

    def judge(text: int, item: int, best: tuple[float, int], found: list[float]) -> None:
        if found[0] >= QUESTION and found[1] >= ANSWER:
            out[text, item] = max(out.get((text, item), (-math.inf,)), (*best, *found))

    for text, a, b, entry, score in hits:
        judge(text, int(index.items[entry]), (score, int(words.edges[text]) - a), shares(index.parts[entry], words, [(a, b)]))
        if index.whole[entry] >= 0:
            spans = several.setdefault((text, index.whole[entry], int(index.items[entry])), {})
            spans[a, b] = max(score, spans.get((a, b), 0.0))
    for (text, whole, item), spans in several.items():
        best = max((score, int(words.edges[text]) - a) for (a, _), score in spans.items())
        judge(text, item, best, shares(index.wholes[whole], words, list(spans)))
    return out


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each item, as signed hashes."""
    for batch in batches:
        for chunk in chunks(pc.utf8_lower(batch.column("text"))):
            words = chunk.words(between=PUNCTUATION)
            mine = [np.unique(words.hash[a:b]) for a, b in zip(words.edges[:-1], words.edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *mine]).view(np.int64))], ["term"])


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items with words, entries, and words of the entries."""
    for batch in batches:
        for chunk in chunks(pc.utf8_lower(batch.column("text"))):
            counts = [n for n in chunk.words(between=PUNCTUATION).counts.tolist() if n]
            entries = [(len(starts_of(n)), min(n, ENTRY)) for n in counts]
            sums = len(counts), sum(k for k, _ in entries), sum(k * n for k, n in entries)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in sums], ["items", "entries", "words"])


def slices(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes over all items, about SLICE entries in each. benchmark: item_id, text. All texts of an item are in one slice."""
    items = benchmark.select("item_id", "text").filter("item_id is not null and text is not null")
    size = items.select("text").mapInArrow(_sizes, "items long, entries long, words long").agg(*(F.sum(c).alias(c) for c in ("items", "entries", "words"))).first()
    if not size["entries"]:
        return
    n = -(-size["entries"] // SLICE)
    held = shared(items.select("text").mapInArrow(_terms, "term long").groupBy("term").agg(F.count("*").alias("held")))
    for k in range(n):
        part = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        rows = sorted(tuple(r) for r in part.collect())
        mine = part.select("text").mapInArrow(_terms, "term long").distinct().join(held, "term").toArrow()
        terms = mine.column("term").to_numpy().view(np.uint64)
        order = np.argsort(terms)
        if index := build_index(rows, Weights(size["items"], size["words"] / size["entries"], terms[order], mine.column("held").to_numpy()[order])):
            yield index


def _found(index: Index, column: pa.Array) -> Iterator[tuple[int, int, tuple]]:
    for chunk in chunks(pc.utf8_lower(column)):
        words = chunk.words(between=PUNCTUATION)
        for (text, item), best in sorted(verified(index, words, retrieve(index, words)).items()):
            yield chunk.first + text, item, best


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item that it leaks: HITS; passage is the first word's place."""
    out = None
    for index in slices(benchmark):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[i], item, -best[1], best[0], *best[2:]) for i, item, best in _found(index, batch.column("text"))]
                columns = zip(*rows, strict=True) if rows else [[]] * 6
                kinds = [pa.int64()] * 3 + [pa.float64()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in HITS.split(", ")])

        part = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, HITS)
        out = part if out is None else out.unionAll(part)
    return documents.sparkSession.createDataFrame([], HITS) if out is None else out


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, with their columns."""
    out = documents
    for index in slices(benchmark):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[i for i, _, _ in _found(index, batch.column("text"))]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, documents.schema)
    return out
