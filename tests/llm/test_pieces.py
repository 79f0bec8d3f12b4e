"""SentencePiece encoding: equal to the library on random and on real texts, and decoded again."""

import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeworks.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ALL = [LIBRARY.id_to_piece(i).replace("▁", " ") for i in range(259, LIBRARY.get_piece_size())]


def expected(text):
    return LIBRARY.encode(text or "", add_eos=True)


def check(text, encoder=None):
    got = (encoder or pieces.Encoder.of(PATH)).encode(text)
    assert [int.from_bytes(got[i : i + 4], "little") for i in range(0, len(got), 4)] == expected(text)


@settings(max_examples=600, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    check(text.encode("utf-8", "ignore").decode())


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aeinorst  \n.▁-=_<s>/0x41ABé́漢\U0001f642\x00\t")), max_size=120))
def test_few_letters(text):
    check(text)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(ALL), max_size=20))
def test_joined_pieces(parts):
    check("".join(parts))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aehnrst")), min_size=20, max_size=300))
def test_backtracking(word):
    encoder = pieces.Encoder.of(PATH)
    assert encoder.pieces(word) == encoder.merge(word)


def test_every_piece():
    for p in ALL:
        check(p)


def test_small_tables():
    """Full tables of words and pairs are halved; ids stay the same."""
    small = pieces.Encoder(PATH, words=3, pairs=4)
    for text in ("some words in a row, and more of them", "andere Wörter", "some words in a row, and more of them"):
        check(text, small)
    assert len(small.known) <= 12 and len(small.fits) <= 4


def test_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = pieces.digests(documents, PATH).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert len(rows) == len(texts)
    for r in rows:
        ids = expected(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids)))


def test_edge_cases(spark, edge, documents):
    from .conftest import EDGE

    texts = [*EDGE, "x" * 1_200_000, "<s> </s> <unk> <0x41>", "▁▁ a", "  leading and trailing  ", "same", "same"]
    encoded = pieces.encode(documents(texts), PATH)
    assert {r.doc_id: r.ids for r in encoded.collect()} == {i: expected(t) for i, t in enumerate(texts)}
    back = {r.doc_id: r.text for r in pieces.decode(encoded, PATH).collect()}
    assert back == {i: LIBRARY.decode(expected(t)) for i, t in enumerate(texts)}
    assert pieces.encode(edge.limit(0), PATH).count() == pieces.decode(encoded.limit(0), PATH).count() == 0
    assert pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PATH).first().text == ""


def test_no_model():
    with pytest.raises(RuntimeError):
        pieces.Encoder("/nowhere.model")
