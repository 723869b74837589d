"""Packing: ids against the vocabulary's own library, whole round trips, best fit against a plain search."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from normtrace.llm import best_fit, best_fit_decreasing
from normtrace.llm.ids import id_bytes, piece_starts


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    id_bytes()  # loaded once, before anything is timed
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def ids_of(text):
    return np.frombuffer(id_bytes()(text), "<u4").tolist()


@given(st.text(max_size=60))
def test_ids_equal_library(library, text):
    assert ids_of(text) == library(text)


def test_ids_equal_library_on_documents(library, documents):
    for row in documents.limit(60).collect():
        assert ids_of(row.text) == library(row.text)
    for text in ("<|endoftext|> x", "a<|endoftext|><|endoftext|>", " <|endoftext| >", "it's  we'll 'S", "a \n b\n\n  c\t\td", "\x85\x1c 　x", "1½² 日本語 éà"):
        assert ids_of(text) == library(text)


def test_pieces_cut_only_what_is_longer():
    assert piece_starts(2048, 2048) == [0]
    assert piece_starts(2049, 2048) == [0, 1]
    assert piece_starts(4096, 2048) == [0, 2048]
    assert piece_starts(0, 2048) == []


def test_open_sequences_against_plain_search():
    random.seed(3)
    packer, open_, made = best_fit.OpenSequences(100, 5), [], 0
    for size in (random.randint(1, 100) for _ in range(4000)):
        fits = [f for f in open_ if f[0] >= size]
        if fits:
            least = min(f[0] for f in fits)
            mine = [f for f in open_ if f[0] == least][-1]
            open_.remove(mine)
        else:
            if len(open_) == 5:
                least = min(f[0] for f in open_)
                open_.remove([f for f in open_ if f[0] == least][-1])
            mine, made = (100, made), made + 1
        want = mine[1], 100 - mine[0]
        if mine[0] > size:
            open_.append((mine[0] - size, mine[1]))
        assert packer.place(size) == want


def check_packed(rows, texts, library, limit):
    """Offsets leave no gap, pieces cover their documents, checksums are those of the library's ids."""
    for where in {r.sequence_id for r in rows}:
        mine = sorted((r for r in rows if r.sequence_id == where), key=lambda r: r.offset)
        ends = np.cumsum([r.length for r in mine]).tolist()
        assert [r.offset for r in mine] == [0, *ends[:-1]] and ends[-1] <= limit
    seen = {}
    for r in rows:
        seen.setdefault((r.doc_id, r.piece), []).append(r)
    for key, text in texts:
        ids = np.array([*library(text), 0], "<u4")
        starts = piece_starts(len(ids), limit)
        for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            r = seen[key, i].pop()
            assert (r.start, r.length, r.ids_crc32) == (a, b - a, zlib.crc32(ids[a:b].tobytes()))
    assert not any(seen.values())


def test_packs_documents_whole(spark, documents, library):
    rows = best_fit.pack_documents(documents).collect()
    check_packed(rows, [(r.doc_id, r.text) for r in documents.collect()], library, 2048)
    used = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= 1.02 * used / 2048 + 2


def test_packs_odd_documents(odd_docs, library):
    check_packed(best_fit.pack_documents(odd_docs, 512).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()], library, 512)


def test_packs_nothing(no_docs):
    assert best_fit.pack_documents(no_docs).count() == 0
    assert best_fit_decreasing.pack_matrices(no_docs).count() == 0


def test_free_space_against_plain_search():
    random.seed(4)
    free, plain = best_fit_decreasing.FreeSpace(100), []
    for i in range(3000):
        if random.random() < 0.6:
            space = random.randint(1, 100)
            free.put(space, i)
            plain.append((space, i))
        else:
            least = random.randint(0, 100)
            got = free.take(least)
            fits = [p for p in plain if p[0] >= least]
            assert (got is None) == (not fits)
            if fits:
                assert got in plain and got[0] == min(p[0] for p in fits)
                plain.remove(got)


def test_window_is_best_fit_decreasing():
    random.seed(5)
    sizes = [random.randint(1, 50) for _ in range(400)]
    rows = best_fit_decreasing.pack_window([(i, 0, 0, np.zeros(n, "<u2")) for i, n in enumerate(sizes)], 50)
    plain = []
    for n in sorted(sizes, reverse=True):
        fits = [b for b in plain if 50 - sum(b) >= n]
        min(fits, key=lambda b: 50 - sum(b)).append(n) if fits else plain.append([n])
    assert sorted(sum(len(p[3]) for p in r) for r in rows) == sorted(map(sum, plain))  # ties may fall either way
    assert sorted(p[0] for r in rows for p in r) == list(range(400))


@pytest.mark.parametrize("window", [1 << 22, 3000])
def test_matrices_give_documents_back(odd_docs, documents, library, window):
    for docs, limit in ((odd_docs, 512), (documents, 2048)):
        packed = best_fit_decreasing.pack_matrices(docs, limit, window_tokens=window)
        for row in packed.collect():
            positions = np.frombuffer(row.positions, "<u2")
            ids = np.frombuffer(row.ids, "<u2")
            assert len(ids) == limit and row.cu_seqlens[-1] == row.n_tokens and not ids[row.n_tokens:].any()
            for a, b in zip(row.cu_seqlens, row.cu_seqlens[1:]):
                assert positions[a:b].tolist() == list(range(b - a))
        parts = {}
        for s in best_fit_decreasing.unpack_matrices(packed).collect():
            parts.setdefault(s.doc_id, []).append((s.piece, s.start, np.frombuffer(s.ids, "<u2").tolist()))
        texts = {}
        for r in docs.collect():
            texts.setdefault(r.doc_id, []).append([*library(r.text), 0])
        assert parts.keys() == texts.keys()
        for key, found in parts.items():
            copies = len(texts[key])
            for piece, start, ids in found:
                assert ids == texts[key][0][start:start + len(ids)]
            assert sum(len(f[2]) for f in found) == copies * len(texts[key][0])
