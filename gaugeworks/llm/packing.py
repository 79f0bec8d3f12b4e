"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Every document becomes token ids, an end id last. Whole windows are cut off its front; the rest, cut again into pieces
of at most PIECE, joins the rests of other documents of the same input partition. Each GROUP of such pieces is split
into windows by multiway differencing: every piece starts as a partial partition of k windows; the two partial
partitions with the widest imbalance merge, the fullest window of one with the emptiest of the other, until one is
left, whose windows are nearly equal. k starts at the least number that could hold the pieces and rises by one while
any window would exceed the capacity.

Nothing is shuffled: pieces are packed in the task that reads them, so a key or a source with many rows has no effect,
memory is one batch of texts and one group, and a lost task is computed again with the same result. A group's windows share
its slack: their number is the least that holds its pieces, so many small partitions pad more than a few large ones.

Defined cases: null and empty texts are the end id alone; texts that spell a special token get its id, as the tokenizer reads
them; repeated rows and pieces of equal length are packed each, in input order; very long texts are encoded whole; an empty
table gives no rows; other columns than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

CAPACITY = 2048
PIECE = 512
GROUP = 2048
CACHE = 400_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, padded_length long"


def differencing(sizes: np.ndarray, k: int) -> list[list[int]]:
    """k windows of item numbers with near-equal sums (the largest differencing method for k subsets).

    A partial partition has its windows' sums in ascending order, without the leading zeros of the k windows. Most merges
    take in a single piece, which is one insertion."""
    heap: list[tuple[int, int, list[int], list[list[int]]]] = [(-size, i, [size], [[i]]) for i, size in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    base = len(sizes)
    while len(heap) > 1:
        _, _, sums, items = heapq.heappop(heap)
        _, _, b, b_items = heapq.heappop(heap)
        if len(sums) < len(b):
            sums, items, b, b_items = b, b_items, sums, items
        if len(b) == 1:
            size, mine = b[0], b_items[0]
            if len(sums) == k:
                size, mine = size + sums.pop(0), items.pop(0) + mine
            at = bisect.bisect_right(sums, size)
            sums.insert(at, size)
            items.insert(at, mine)
        else:
            # the last of one meet the first of the other
            over = max(0, len(sums) + len(b) - k)
            both = [*zip(sums[over:], items[over:], strict=True), *zip(b[over:], b_items[over:], strict=True)]
            both += [(x + y, p + q) for x, y, p, q in zip(sums[:over], b[:over][::-1], items[:over], b_items[:over][::-1], strict=True)]
            both.sort(key=lambda x: x[0])
            sums, items = [x for x, _ in both], [x for _, x in both]
        base += 1
        heapq.heappush(heap, ((sums[0] if len(sums) == k else 0) - sums[-1], base, sums, items))
    return heap[0][3] if heap else []


def windows(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Windows of at most capacity; their number rises until all fit."""
    if not len(sizes):
        return []
    k = -(-int(sizes.sum()) // capacity)
    while True:
        found = differencing(sizes, k)
        if max(int(sizes[x].sum()) for x in found) <= capacity:
            return found
        k += 1


def padded(length: int, capacity: int) -> int:
    """A sequence is padded to the capacity, but a power of two stays as it is."""
    return length if length & (length - 1) == 0 else capacity


class WordCache:
    """Ids of the parts of a text that split() gives.

    Where it holds CACHE parts, the older half stays, as frequent parts come early; longer parts than LONG are never kept.
    Parts of letters alone are one word each and go to the tokenizer's model, the others through the whole tokenizer, RUN at
    a time: its cost for each part rises with the text's length."""

    LONG = 64
    RUN = 500
    _of: dict[str, WordCache] = {}

    @classmethod
    def of(cls, path: str) -> WordCache:
        """One for each worker process, kept from task to task."""
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def __init__(self, path: str, limit: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism; more threads spin
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.known = Tokenizer.from_file(path), limit, {"": b""}
        self.special = [x.content.lower() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        letters = [chr(c) for c in _STORED]
        self.direct = all(self.word(x) == np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in [*letters, "".join(letters), "hello", "straße", "élève"])

    def word(self, part: str) -> bytes:
        """Ids of a part that _LETTERS matches, from the model alone."""
        return b"".join([self.bytes[x.id] for x in self.model.tokenize(part if part.isascii() else part.translate(_STORED))])

    def holds_special(self, text: str) -> bool:
        """Whether the text, in lower case, spells a token that the tokenizer takes out before it splits words."""
        lower = text.lower()
        return any(x in lower for x in self.special)

    def encode(self, texts: list[str], end: int) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, the end id last."""
        tail = end.to_bytes(4, "little")
        if len(self.known) > self.limit:
            self.known = dict(itertools.islice(self.known.items(), 1 + self.limit // 2))
        known = self.known
        out: list[bytes] = []
        open_: dict[int, list[str]] = {}  # texts with parts that aren't known
        for i, text in enumerate(texts):
            if self.holds_special(text):
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + tail)
                continue
            parts = split(text)
            try:
                out.append(b"".join(map(known.__getitem__, parts)) + tail)
            except KeyError:
                open_[i] = parts
                out.append(b"")
        extra: dict[str, bytes] = {}
        rest: list[str] = []
        for part in set().union(*open_.values()).difference(known):
            if self.direct and len(part) <= self.LONG and _LETTERS.fullmatch(part):
                known[part] = self.word(part)
            else:
                rest.append(part)
        for i in range(0, len(rest), self.RUN):
            some = rest[i : i + self.RUN]
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids = np.array(found.ids, "<u4").tobytes()
            starts = np.cumsum([0, *(len(x) + 1 for x in some)])
            cuts = (4 * np.searchsorted([a for a, _ in found.offsets], starts)).tolist()
            for part, a, b in zip(some, cuts[:-1], cuts[1:], strict=True):
                (known if len(part) <= self.LONG else extra)[part] = ids[a:b]
        for i, parts in open_.items():
            out[i] = b"".join([known[x] if x in known else extra[x] for x in parts] if extra else map(known.__getitem__, parts)) + tail
        return out


#: Letters that the tokenizer's normalizer leaves as they are: lower-case ones of ASCII and Latin-1; and how byte-level models write them.
_LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = dict(zip([*_PRINTED, *(b for b in range(256) if b not in _PRINTED)], map(chr, [*_PRINTED, *range(256, 512)]), strict=False))
_STORED = {c: "".join(_BYTES[b] for b in chr(c).encode()) for c in range(256) if _LETTERS.fullmatch(chr(c))}

_GLUED = re.compile(r"[.,](?<=(?:[^\w\s]|[_\x1c-\x1f])[.,])")


def split(text: str) -> list[str]:
    """Parts of a text between which no token reaches: at spaces, line breaks and, after a letter or digit, at . and ,

    The tokenizer lower-cases by itself; doing it here first saves cache entries, but for the sigma, whose lower case
    depends on its place. A text that isn't in composed form may get marks from the tokenizer, which join what follows."""
    if "\u03a3" not in text and unicodedata.is_normalized("NFC", text):
        text = text.lower()
        if not _GLUED.search(text):
            text = text.replace(".", " .").replace(",", " ,")
    return text.replace("\n", " ").split(" ")


def pack(documents: DataFrame, tokenizer: str, end: int = 1, capacity: int = CAPACITY, piece: int = PIECE, group: int = GROUP) -> DataFrame:
    """One row for each piece of a document, by SCHEMA. documents: doc_id, text. tokenizer: the file's path.

    sequence_id holds the number of the input partition and, below it, that of the sequence in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache.of(tokenizer)
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 36
        rows: list[tuple] = []
        rests: list[tuple] = []

        def flush() -> None:
            nonlocal sequence
            for window in windows(np.array([r[2] for r in rests]), capacity):
                full = sum(rests[i][2] for i in window)
                at = 0
                for i in sorted(window):
                    rows.append((*rests[i], sequence, at, full, padded(full, capacity)))
                    at += rests[i][2]
                sequence += 1
            rests.clear()

        def take() -> pa.RecordBatch:
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            out = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names)
            rows.clear()
            return out

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            step = 256
            for i in range(0, len(ids), step):
                some = [x or "" for x in texts.slice(i, step).to_pylist()]
                for doc, tokens in zip(ids[i : i + step], cache.encode(some, end), strict=True):
                    total = len(tokens) // 4
                    start = 0
                    while start < total:
                        length = min(capacity if total - start >= capacity else piece, total - start)
                        row = (doc, start, length, zlib.crc32(tokens[4 * start : 4 * (start + length)]), total)
                        if length == capacity:
                            rows.append((*row, sequence, 0, capacity, capacity))
                            sequence += 1
                        else:
                            rests.append(row)
                        start += length
                    if len(rests) >= group:
                        flush()
                if len(rows) >= 50_000:
                    yield take()
        flush()
        yield take()

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)
