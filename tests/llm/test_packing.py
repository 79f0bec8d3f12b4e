"""Packing: an exact round trip through the tokenizer, windows that fit, little padding."""

import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gaugeworks.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
REFERENCE = Tokenizer.from_file(PATH)


def ids(text):
    return np.array([*REFERENCE.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aAbsS't.,#*_ \n\t\ŕÉΣσİK²1９ǅẞ<|>\x1c\x85中한​")), max_size=40))
def test_tokens(text):
    assert packing.WordCache.of(PATH).encode([text, "known words", text], 1) == [ids(x).tobytes() for x in (text, "known words", text)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "hello", " ", ".", ",", "W", "\n"]), max_size=12))
def test_special_tokens(parts):
    text = "".join(parts)
    assert packing.WordCache.of(PATH).encode([text], 1) == [ids(text).tobytes()]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from([chr(c) for c in range(97, 123)] + [chr(c) for c in range(0xC0, 0x100)] + list("ªºµŉſıﬀά*'7-")), max_size=70), max_size=8), st.booleans())
def test_letters(words, direct):
    """Words of letters by the model alone, and with the whole tokenizer."""
    cache = packing.WordCache.of(PATH)
    assert cache.direct
    cache.known, cache.direct = {"": b""}, direct
    try:
        assert cache.encode([" ".join(words)], 1) == [ids(" ".join(words)).tobytes()]
    finally:
        cache.direct = True


def test_full_cache():
    """A full cache keeps its older half, stays bounded and gives the same ids."""
    cache = packing.WordCache(PATH, 4)
    for text in ("the", "some more words, don't you see", "others", "words again 12 *** straße", "others"):
        assert cache.encode([text], 1) == [ids(text).tobytes()]
        assert "the" in cache.known and "" in cache.known
    cache.encode([""], 1)
    assert len(cache.known) <= 5


def test_contract_ids():
    assert ids("hello <|endoftext|> world").tolist() == [3306, 49407, 1002, 1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=40))
def test_windows(sizes):
    found = packing.windows(np.array(sizes, int), 100)
    assert sorted(i for w in found for i in w) == list(range(len(sizes))) and all(sum(sizes[i] for i in w) <= 100 for w in found)


def test_differencing():
    """The known example: {8, 7, 6, 5, 4} in two sets differ by 2; near-equal windows in general."""
    sums = sorted(sum((8, 7, 6, 5, 4)[i] for i in w) for w in packing.differencing(np.array([8, 7, 6, 5, 4]), 2))
    assert sums == [14, 16]
    sizes = np.random.default_rng(1).integers(1, 512, 2000)
    found = [sizes[w].sum() for w in packing.differencing(sizes, 250)]
    assert max(found) - min(found) < 20


def check(rows, texts):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == r.sequence_length <= 2048 and r.padded_length == packing.padded(at, 2048)
    for doc, text in texts.items():
        mine, at = ids(text), 0
        for r in sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(mine) and r.ids_crc32 == zlib.crc32(mine[at : at + r.length].tobytes())
            at += r.length
        assert at == len(mine)
    return by


def test_round_trip(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(documents, PATH).collect()
    by = check(rows, {r.doc_id: r.text for r in documents.collect()})
    total = sum(r.length for r in rows)
    assert len(by) <= -(-total // 2048) + 3


def test_edge_cases(spark, edge):
    from .conftest import EDGE

    check(packing.pack(edge, PATH).collect(), dict(enumerate(EDGE)))
    texts = {0: "a <|endoftext|> b", 1: "long words " * 150_000 + "end", 2: "x" * 3000 + " y", 3: "x" * 3000 + " y"}
    check(packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), PATH).collect(), texts)
    assert packing.pack(edge.limit(0), PATH).count() == 0
