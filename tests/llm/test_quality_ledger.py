"""Quality ledger: measurements by definition, rules once, policies and ablations by bits."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from normtrace.llm import quality_ledger as ql

TEXTS = [
    None, "", " \n ", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 100, "the same line\nthe same line\n\n\nother\nthe same line ",
    "# * $ % & | < > words", "WOW! THIS! IS! LOUD!", "ein schöner Text mit Wörtern " * 5, "a b c d e f g h i j k\x1cl m", "w" * 50_000, "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8",
]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i:i + 8]), []).append(i)
    inside = {i + j for places in windows.values() if len(places) > 1 for i in places for j in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside),
            len(lines), text.count("!"), len(re.findall("[A-Z]", text)), len(re.findall("[A-Za-z]", text)))


def failures(m):
    return sum(1 << i for i, rule in enumerate(ql.RULES.values()) if eval(rule, {}, dict(zip(ql.MEASURES, m))))


def measured(texts):
    found = ql.measure([t or "" for t in texts])
    return [tuple(int(found[m][i]) for m in ql.MEASURES) for i in range(len(texts))]


def test_measurements_by_definition():
    assert measured(TEXTS) == [plain(t) for t in TEXTS]
    assert [measured([t])[0] for t in TEXTS] == [plain(t) for t in TEXTS]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "\n", "!", "C"]), max_size=60), max_size=4))
def test_measurements_of_repetitive_texts(parts):
    texts = [" ".join(p) for p in parts]
    assert measured(texts) == [plain(t) for t in texts]


def test_judge(odd_docs, no_docs):
    want = []
    for r in odd_docs.collect():
        m = plain(r.text)
        bits = failures(m)
        want.append((r.doc_id, *m[:5], bits & 3 != 0, bits == 0, bits))
    assert sorted(map(tuple, ql.judge(odd_docs).collect()), key=repr) == sorted(want, key=repr)
    assert ql.judge(no_docs).count() == 0


def test_policies_and_ablations(documents):
    book = ql.ledger(documents).cache()
    bits = [r.failures for r in book.collect()]
    found = {(r.policy, r.rule): r for r in ql.ablations(book).collect()}
    assert set(found) == {(p, r) for p, names in ql.POLICIES.items() for r in names}
    for (policy, rule), r in found.items():
        mask, bit = ql.mask(policy), ql.BITS[rule]
        also = 0
        for b in bits:
            also |= b & mask & ~bit if b & bit else 0
        assert (r.n_docs, r.n_rejected, r.n_failed, r.n_only, r.n_also) == (
            len(bits), sum(b & mask != 0 for b in bits), sum(b & bit != 0 for b in bits), sum(b & mask == bit for b in bits), also)
    assert book.where(ql.rejected(2)).count() == found[2, "symbols"].n_rejected


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    rows = ql.judge(docs).join(docs.select("doc_id", "quality"), "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r for r in rows if r.quality == 0 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(not r.kept for r in bad) >= 0.4 * len(bad)


def test_no_documents_have_no_ablations(no_docs):
    assert ql.ablations(ql.ledger(no_docs)).count() == 0
    with pytest.raises(ValueError):
        ql.measurements(no_docs, window=6)
