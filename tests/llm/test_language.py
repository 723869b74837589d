"""Language ID: code lengths against a plain tree walk, held-out accuracy, odd texts."""

import math

import numpy as np
import pytest

from normtrace.llm import language, queries


@pytest.fixture(scope="module")
def model(spark):
    return language.learn(queries.table(spark, "/root/testdata/sf0.01", "documents"))


def plain_bits(counts, text, lang, order):
    data, bits = language.framed(text), 0.0
    for i in range(1, len(data)):
        for k in range(min(order, i), -1, -1):
            seen = counts.get((lang, data[i - k:i]), {})
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if data[i] in seen:
                bits -= math.log2(seen[data[i]] / total)
                break
            bits -= math.log2(len(seen) / total)
        else:
            bits += 8
    return bits


def test_code_lengths_equal_plain_walk():
    texts = {"aa": [b"the cat sat on the mat", b"that hat"], "bb": [b"der hut ist gut", b"das ist der hut"]}
    rows = {}
    for lang, each in texts.items():
        for text in each:
            data = language.framed(text)
            for size in range(1, 6):
                for i in range(len(data) - size + 1):
                    part = data[i:i + size]
                    if 0 not in part:
                        key = (lang, size, int.from_bytes(part, "big"))
                        rows[key] = rows.get(key, 0) + 1
    model = language.freeze([(*k, n) for k, n in rows.items()], least_seen=1)
    counts = {}
    for (lang, size, number), n in rows.items():
        part = number.to_bytes(size, "big")
        counts.setdefault((lang, part[:-1]), {})[part[-1]] = n
    tried = [b"the hut", b"", b"zzz q", b"mat der ist \xc3\xa9"]
    got = model.code_lengths(tried)
    for text, bits in zip(tried, got):
        assert bits == pytest.approx([plain_bits(counts, text, lang, 4) for lang in ("aa", "bb")], abs=1e-9)
    assert np.allclose(model.code_lengths([b"the hut"]), got[:1])


def test_blocks_do_not_matter(model, monkeypatch):
    texts = [b"the of and in that with ", b"der die das und mit", b"", b"x"] * 5
    whole = model.code_lengths(texts)
    monkeypatch.setattr(language, "BYTES_AT_ONCE", 17)
    assert np.allclose(model.code_lengths(texts), whole)


def test_held_out_accuracy(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang")
    out = queries.op3_language(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out").collect()
    assert len(out) > 200 and sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_odd_texts(odd_docs, model):
    got = {r.doc_id: r for r in language.identify(odd_docs, model).collect()}
    assert language.identify(odd_docs, model).count() == odd_docs.count()
    assert [got[i].lang_pred for i in (0, 1, 2, 3)] == ["und"] * 4 and got[0].score == 0
    assert got[9].lang_pred in model.langs and got[None].lang_pred in model.langs
    assert language.drop_unreadable(odd_docs, model).columns == odd_docs.columns


def test_nothing_to_learn(spark, no_docs, odd_docs):
    assert language.learn(no_docs) is None
    assert {r.lang_pred for r in language.identify(odd_docs, None).collect()} == {"und"}
    assert language.identify(no_docs, None).count() == 0


@pytest.mark.parametrize("labelled", [0, 1, 4])
def test_few_or_no_labels_keep_lettered_texts(spark, labelled):
    rows = [(i, f"some plain words number {'x' * i}", "en" if i < labelled else None) for i in range(20)] + [(20, "12 34", None), (21, None, None), (22, "чистый текст", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = language.drop_unreadable(docs, language.learn(docs))
    assert sorted(r.doc_id for r in kept.collect()) == [*range(20), 22]


def test_samples_are_distinct_texts_up_to_an_exact_count(spark):
    rows = [(f"text {i % 500}", "en") for i in range(2000)] + [("copied", "en")] * 3000 + [("one", "de"), (None, "fr"), ("unnamed", None)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    for size, en in ((50, 50), (10_000, 501)):
        found = [tuple(r) for r in language.sample_texts(docs, size).collect()]
        assert len(found) == len(set(found)) == en + 1 and ("de", "one") in found
