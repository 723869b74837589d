"""Fill-in-the-middle: cuts, forms and digests by definition, frames of any size, exact restoring."""

import hashlib
import re

import pytest

from normtrace.llm import fill_middle as fm

TEXTS = [
    None, "", "a", "word", "two words", "ab1cd  é-ß", "\n\n", "<P> inside", "x <S", "<<<P", "P>S>M>", "日本 text \U0001f642 end", "x" * 300, "ab " * 200, "1234567890" * 30, "same", "same",
]


def expected(key, text, epoch=1):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    h = hashlib.sha256(f"{epoch}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return key, len(units), "plain", None, None, sha(text), sha(text)
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = ("".join(p) for p in (units[:low], units[low:high], units[high:]))
    if h4 % 100 < 20:
        return key, len(units), "spm", len(prefix), len(middle), sha(f"<S>{suffix}<P>{prefix}<M>{middle}"), sha(text)
    return key, len(units), "psm", len(prefix), len(middle), sha(f"<P>{prefix}<S>{suffix}<M>{middle}"), sha(text)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("frame_chars", [1, 2, 7, 64, fm.FRAME_CHARS])
def test_any_frame_size(spark, frame_chars):
    rows = [(8 * i + j if i else None, t) for i, t in enumerate(TEXTS) for j in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = fm.with_digests(fm.fill_middle(fm.store_frames(docs, frame_chars)))
    assert rows_of(found) == sorted((expected(*r) for r in rows), key=repr)


def test_odd_documents_and_none(odd_docs, no_docs):
    assert rows_of(fm.digest_documents(odd_docs)) == sorted((expected(r.doc_id, r.text) for r in odd_docs.collect()), key=repr)
    assert fm.digest_documents(no_docs).count() == 0


def test_one_store_serves_epochs(documents):
    store = fm.store_frames(documents)
    texts = {r.doc_id: r.text for r in documents.collect()}
    forms = {}
    for epoch in (1, 2):
        for r in fm.fill_middle(store, epoch).collect():
            assert b"".join(fm.restored(r.form, r.output)).decode() == texts[r.doc_id]
            whole = fm.output_text(r.output)
            assert expected(r.doc_id, texts[r.doc_id], epoch)[5] == hashlib.sha256(whole.encode()).hexdigest()
            forms.setdefault(r.doc_id, []).append((r.form, r.prefix_chars))
    assert sum(a != b for a, b in forms.values()) > len(forms) / 2


def test_only_cut_frames_are_expanded():
    compress = fm.zstandard.ZstdCompressor(level=1).compress
    n, frames = fm.frames_of("some words and more " * 500, compress, 100)
    cutter, seen = fm.Cutter(), []
    expand = cutter.expand
    cutter.expand = lambda data: seen.append(data) or expand(data)
    row = {"doc_id": 3, "n": n, "n_chars": 10_000, "marked": False, "frames": frames}
    out = cutter.transform(row, 1)
    assert out[2] != "plain" and len(set(seen)) <= 2 < len(frames)
    assert all(f["data"] in out[5] for f in frames if f["data"] not in seen)
