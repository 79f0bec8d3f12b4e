"""SentencePiece encoding and decoding: exact merge-type encoding by backtracking.

The library merges neighbouring symbols, the best-scored piece first and the leftmost of equals, until no two neighbours form a
piece. Its result is the one sequence of pieces in which every two neighbours, merged again alone, stay apart as they are. So a word
is encoded from left to right: an Aho-Corasick automaton gives the longest piece at every position; it is taken if its end isn't
known to fail and it is compatible with the piece before; else the next shorter prefix that is a piece is tried; where none is left,
the position goes into a bitfield of failed positions and the last piece is taken back. Compatibility is judged by merging the two
pieces' characters again, and remembered. Characters that are no piece become their UTF-8 bytes' pieces.

Words are encoded apart: they begin before spaces that follow another character, behind the last of some letters, and at line breaks,
where no piece of the model reaches across. That is looked up in the model; a text is split less, or not at all, where it doesn't
hold. Known words come from a bounded table of the worker.

Nothing is shuffled: a text is encoded whole in the task that reads it, so keys, sources and copies have no effect; a
lost task is computed again with the same result. Memory is one Arrow batch, the table of words and one text's ids.

Defined cases: null and empty texts are the end id alone and decode to the empty text; control tokens spelled in a text are plain
characters; repeated rows and ids are encoded each; very long texts and words are encoded whole; an empty table gives no
rows; other columns than doc_id and text are ignored, whatever their names. The model must be of the merge type (BPE), without user-defined or
unused pieces, and leave characters as they are but for spaces; else ValueError.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
LETTER = re.compile(r"[^\W\d_]")
WORDS = 400_000
PAIRS = 500_000
LONG = 64
CHUNK = 1 << 20
#: Texts on which the model must keep every character, spaces apart.
PLAIN = "a  Bé́ﬁ　​­\t\n Ａẞ "


class Encoder:
    """Ids of texts by a model file. Pieces are kept with plain spaces."""

    _of: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One for each worker process, kept from task to task."""
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def __init__(self, path: str, words: int = WORDS, pairs: int = PAIRS):
        import ahocorasick
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m, every = self.model, range(self.model.get_piece_size())
        named = [i for i in every if not (m.is_control(i) or m.is_byte(i) or m.is_unknown(i))]
        if any(m.is_unused(i) for i in named) or m.normalize(PLAIN) != (SPACE + PLAIN).replace(" ", SPACE):
            raise ValueError(f"{path}: not a plain model of the merge type")
        self.id = {m.id_to_piece(i).replace(SPACE, " "): i for i in named}
        self.score = {p: m.get_score(i) for p, i in self.id.items()}
        self.ids = {p: i.to_bytes(4, "little") for p, i in self.id.items()}
        self.byte = [m.piece_to_id(f"<0x{b:02X}>").to_bytes(4, "little") for b in range(256)]
        self.end = m.eos_id()
        self.words, self.pairs = words, pairs
        self.known: dict[str, bytes] = {"": b""}
        self.fits: dict[tuple[str, str], bool] = {}
        self.shorter: dict[str, str] = {}
        self.automaton = ahocorasick.Automaton()
        for p in self.id:
            if len(p) > 1 and self.merge(p) == [p]:  # other pieces can't come out of merges
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        joins = {(a, b) for p in self.id for a, b in itertools.pairwise(p)}
        if any(b == " " != a for a, b in joins):
            words = "(?s:.+)"
        elif any("\n" in x or (LETTER.match(x[0]) and not LETTER.match(x[1])) for x in joins):
            words = " +[^ ]*"
        else:
            words = r"\n| *(?:[^\w \n]|[\d_])*[^\W\d_]*"
        self.split = re.compile(words).findall

    def merge(self, text: str) -> list[str]:
        """Merges one after another: the best score, then the leftmost place."""
        parts, get, none = list(text), self.score.get, -np.inf
        scores = [get(a + b, none) for a, b in itertools.pairwise(parts)]
        while scores and (best := max(scores)) != none:
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(scores):
                scores[i] = get(parts[i] + parts[i + 1], none)
        return parts

    def compatible(self, pair: tuple[str, str]) -> bool:
        """Whether the two pieces stay as they are when their characters are merged again."""
        found = self.fits.get(pair)
        if found is None:
            if len(self.fits) >= self.pairs:
                for k in list(self.fits)[self.pairs // 2 :]:
                    del self.fits[k]
            found = self.fits[pair] = self.merge(pair[0] + pair[1]) == list(pair)
        return found

    def prefix(self, piece: str) -> str:
        """The longest shorter prefix that can be a piece; empty for one character."""
        found = self.shorter.get(piece)
        if found is None:
            found = self.shorter[piece] = next((piece[:k] for k in range(len(piece) - 1, 1, -1) if piece[:k] in self.automaton), piece[:1] if len(piece) > 1 else "")
        return found

    def pieces(self, word: str) -> list[str]:
        """The pieces of a word, by backtracking."""
        longest = list(word)
        for end, p in self.automaton.iter(word):  # by ascending end
            longest[end - len(p) + 1] = p
        size, fits = len(word), self.fits
        failed = bytearray(size // 8 + 1)
        piece = longest[0]
        out, at = [piece], len(piece)
        while at < size:
            piece, last = longest[at], out[-1]
            while piece:
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1 and (ok if (ok := fits.get((last, piece))) is not None else self.compatible((last, piece))):
                    out.append(piece)
                    at = end
                    break
                piece = self.shorter.get(piece) or self.prefix(piece)
            while not piece:  # nothing follows the last piece: its end has failed, and the next shorter one takes its place
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(piece)
                while piece := self.prefix(piece):
                    end = at + len(piece)
                    if not failed[end >> 3] >> (end & 7) & 1 and (not out or self.compatible((out[-1], piece))):
                        out.append(piece)
                        at = end
                        break
        return out

    def word(self, word: str) -> bytes:
        """Ids of a word, little-endian 32-bit."""
        found = self.pieces(word)
        try:
            return b"".join(map(self.ids.__getitem__, found))
        except KeyError:
            return b"".join([self.ids[p] if p in self.ids else b"".join([self.byte[b] for b in p.encode()]) for p in found])

    def encode(self, text: str) -> bytes:
        """Ids of a text, little-endian 32-bit, the end id last."""
        words = self.split(" " + text.replace(SPACE, " ")) if text else []
        known = self.known
        try:
            found = b"".join(map(known.__getitem__, words))
        except KeyError:
            extra: dict[str, bytes] = {}
            for w in set(words).difference(known):
                (known if len(w) <= LONG else extra)[w] = self.word(w)
            found = b"".join([known[w] if w in known else extra[w] for w in words] if extra else map(known.__getitem__, words))
            if len(known) > self.words:
                self.known = dict(itertools.islice(known.items(), self.words // 2))  # the older half: what is frequent comes early
        return found + self.end.to_bytes(4, "little")

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


def encode(documents: DataFrame, model: str, decoded: bool = False) -> DataFrame:
    """doc_id, ids (the end id last) and, if asked for, the text that the ids decode to. model: the file's path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(model)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            start, size, found, back = 0, 0, [], []

            def take(stop: int, ids: pa.Array = ids) -> pa.RecordBatch:
                offsets = np.cumsum([0, *(len(x) // 4 for x in found)]).astype("int32")
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<i4")))
                out = [ids.slice(start, stop - start), lists, *([pa.array(back, pa.string())] if decoded else [])]
                return pa.RecordBatch.from_arrays(out, ["doc_id", "ids", "decoded"][: len(out)])

            for i in range(len(ids)):
                text = texts[i].as_py() or ""
                found.append(encoder.encode(text))
                if decoded:
                    back.append(encoder.decode(np.frombuffer(found[-1], "<i4").tolist()))
                size += len(text)
                if size >= CHUNK or i + 1 == len(ids):
                    yield take(i + 1)
                    start, size, found, back = i + 1, 0, [], []

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null lists decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(model)
        for batch in batches:
            texts = [encoder.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", F.col("ids").cast("array<int>")).mapInArrow(run, f"doc_id {kind}, text string")


def digests(documents: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids, one space between) and decoded_sha256."""
    found = encode(documents, model, decoded=True)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
