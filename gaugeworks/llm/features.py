"""Vectorised word, line and n-gram scanning of Arrow text columns.

Texts are handled as the UTF-8 bytes of an Arrow column. Words are maximal runs of bytes other than space and
0x09-0x0D, the ASCII white space. A word's hash is a polynomial over random 64-bit byte codes modulo 2**64, mixed;
two different words share one with a chance of about 2**-54, so hashes stand for words here. Chunks hold whole
texts, about CHUNK bytes together, so memory depends on the longest text and not on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15  # 1 modulo 4
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _CODES.copy()
_LOWER[65:91] = _CODES[97:123]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
PUNCTUATION = SPACE.copy()  # white space and the ASCII characters that are neither letters nor digits
PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], have = 1, 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
        have += more
    return out


_tables: dict[str, np.ndarray] = {}


def _tables_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n + 1:
        _tables["up"], _tables["down"] = _powers(_BASE, n + 1), _powers(_INVERSE, n + 1)
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hashes of byte spans in ascending order that do not overlap; empty spans allowed."""
    codes = _LOWER if lower else _CODES
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + SEGMENT, "right")))
        high = ends[j - 1]
        up, down = _tables_for(max(SEGMENT, int(high - low)))
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(codes[data[low:high]] * up[: high - low], out=total[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


@dataclass
class Chunk:
    """Some whole texts: their bytes, offsets into them, the row numbers in the batch."""

    data: np.ndarray
    offsets: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        """Marked bytes of each text."""
        total = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(marks, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def words(self, lower: bool = False, between: np.ndarray = SPACE) -> Words:
        """Runs of bytes outside of `between`; with `lower`, hashes see A-Z as a-z."""
        inside = ~between[self.data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        firsts = self.offsets[:-1][self.offsets[:-1] < len(self.data)]
        begins[firsts] = inside[firsts]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:]
        lasts = self.offsets[1:][self.offsets[1:] > 0] - 1
        stops[lasts] = inside[lasts]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        edges = np.searchsorted(starts, self.offsets)
        return Words(span_hashes(self.data, starts, ends, lower), starts, ends, edges)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Of lines with a word: text number and hash."""
        breaks = np.flatnonzero(self.data == 10)
        starts = np.unique(np.concatenate([self.offsets[:-1], breaks + 1]))
        starts = starts[starts < len(self.data)]
        if not len(starts):
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        text = np.searchsorted(self.offsets, starts, "right") - 1
        ends = np.append(starts[1:], len(self.data))
        ends = np.minimum(ends, self.offsets[text + 1])
        ends = ends - ((ends > starts) & (self.data[ends - 1] == 10))
        full = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(~SPACE[self.data], out=full[1:])
        keep = full[ends] > full[starts]
        return text[keep], span_hashes(self.data, starts[keep], ends[keep])


@dataclass
class Words:
    """Words of a chunk: hash, first byte, end; edges[i] is the first word of text i."""

    hash: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    edges: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.edges)

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.edges) - 1), self.counts)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-word windows, and their text numbers."""
        if len(self.hash) < n:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        out = np.zeros(len(self.hash) - n + 1, np.uint64)
        for k in range(n):
            out = out * np.uint64(0xD1342543DE82EF95) + self.hash[k : k + len(out)]
        text = self.text
        same = text[: len(out)] == text[n - 1 :]
        return mix(out[same]), text[: len(out)][same]


def chunks(column: pa.Array | pa.ChunkedArray, size: int = CHUNK) -> Iterator[Chunk]:
    """Whole texts in order; a null counts as empty."""
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if not len(part):
            continue
        part = part.cast(pa.large_string()).fill_null("")
        _, where, raw = part.buffers()
        ends = np.frombuffer(where, np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
        i = 0
        while i < len(part):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + size, "right")) - 1)
            j = min(j, len(part))
            yield Chunk(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i], i)
            i = j


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key stands there more than once."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(len(keys), bool)
    if len(keys) > 1:
        twin = ranked[1:] == ranked[:-1]
        same[order[1:]] = twin
        same[order[:-1]] |= twin
    return same


def keyed(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes that differ between texts."""
    return mix(hashes + (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))


def buckets(chunk: Chunk, bits: int, orders: tuple[int, ...] = (1, 2), chars: tuple[int, ...] = (4,)) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram (of lower-cased words, then of characters): hashed buckets and text numbers."""
    words = chunk.words(lower=True)
    out = []
    for n in orders:
        grams, text = words.grams(n)
        out.append(((mix(grams + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int64), text))
    if chars:
        points = np.frombuffer(chunk.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
        edges = np.append(0, np.cumsum(chunk.per_text((chunk.data & 0xC0) != 0x80)))
        text = np.repeat(np.arange(len(chunk)), np.diff(edges))
        for n in chars:
            if len(points) < n:
                out.append((np.empty(0, np.int64), np.empty(0, np.int64)))
                continue
            key = np.zeros(len(points) - n + 1, np.uint64)
            for k in range(n):
                key = (key + points[k : k + len(key)]) * np.uint64(0x9FB21C651E98DF25)
            key ^= key >> np.uint64(29)
            key *= np.uint64(0xD6E8FEB86659FD93 + 2 * n)
            same = text[: len(key)] == text[n - 1 :]
            out.append(((key >> np.uint64(64 - bits)).astype(np.int64)[same], text[: len(key)][same]))
    return out
