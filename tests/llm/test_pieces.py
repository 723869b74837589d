"""Piece search: the ids of the model's library, for BPE and unigram models, and exact round trips."""

import random
import struct

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from normtrace.llm import pieces


@pytest.fixture(scope="module")
def bpe():
    import public_tokenizers

    return pieces.open_pieces(), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))


def ids(model, text):
    return np.frombuffer(model.encode(text), "<u4").tolist()


@settings(deadline=None)
@given(st.text(max_size=80))
def test_bpe_equals_library(bpe, text):
    text = text.replace("\0", "")
    assert ids(bpe[0], text) == bpe[1].encode(text)
    assert bpe[0].decode(bpe[0].encode(text)) == bpe[1].decode(bpe[1].encode(text)) == text


def test_bpe_on_long_runs(bpe):
    random.seed(6)
    for text in ("a" * 500, "ab" * 300, "thethethe" * 90, " " * 70, "é" * 200, "<s> <0x0A>", *("".join(random.choices("aenthis", k=400)) for _ in range(60))):
        assert ids(bpe[0], text) == bpe[1].encode(text)


def unigram_model(scores):
    """A serialized unigram model of given pieces, identity normalizer."""
    field = lambda number, data: bytes([number << 3 | 2]) + struct.pack("B", len(data)) + data
    piece = lambda text, score, kind: field(1, field(1, text.encode()) + b"\x15" + struct.pack("<f", score) + bytes([0x18, kind]))
    message = piece("<unk>", 0, 2) + piece("<s>", 0, 3) + piece("</s>", 0, 3)
    message += b"".join(piece(t, s, 1) for t, s in scores.items())
    return message + field(2, bytes([0x18, 1])) + field(3, field(1, b"identity") + bytes([0x18, 1, 0x20, 0, 0x28, 1]))


def test_unigram_equals_library():
    random.seed(7)
    parts = ["▁", "a", "b", "c", "ab", "abc", "bc", "ca", "▁a", "▁ab", "cab", "aa", "bb", "abcab"]
    data = unigram_model({p: -1.0 - random.random() * 5 for p in parts})
    mine, library = pieces.Pieces(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    assert mine.kind == pieces.UNIGRAM
    for text in ["", "a", "xyz", "a xx b", *("".join(random.choices("aabbcc x", k=random.randint(1, 200))) for _ in range(300))]:
        assert ids(mine, text) == library.encode(text), text


def test_search_keeps_a_bounded_window(bpe):
    model, most = bpe[0], 0

    class Watched(pieces.Pieces):
        def _meet(self, last, at, done):
            nonlocal most
            most = max(most, len(last))
            return super()._meet(last, at, done)

    watched = Watched.__new__(Watched)
    watched.__dict__ = model.__dict__
    text = "▁" + "ofthetionandthering" * 3000
    assert "".join(watched.search(text)) == text and most < 20 * model.longest


def test_documents(odd_docs, documents, no_docs, bpe):
    for docs in (odd_docs, documents.limit(50)):
        want = sorted(((r.doc_id, bpe[1].encode(r.text or "")) for r in docs.collect()), key=str)
        coded = pieces.encode_documents(docs)
        assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in coded.collect()), key=str) == want
        back = pieces.decode_documents(coded).collect()
        assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=str)
        assert all(r.restored for r in pieces.digest_documents(docs).collect())
    assert pieces.digest_documents(no_docs).count() == 0


def test_short_words_stop_at_their_one_path(bpe):
    random.seed(10)
    for word in ("▁", "▁a", *("▁" + "".join(random.choices("aenthisroué☃", k=random.randint(1, 40))) for _ in range(500))):
        assert bpe[0].short(word) == list(bpe[0].search(word)), word
