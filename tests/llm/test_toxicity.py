"""Toxicity: held-out labels, ordinal fit, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from normtrace.llm import queries, toxicity


def test_held_out_labels(spark):
    docs, labels = (queries.table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = toxicity.learn(docs, labels.where(~fold))
    out = toxicity.score(docs, model).join(labels.where(fold).withColumnRenamed("toxic", "label"), "doc_id").collect()
    toxic, clean = [r for r in out if r.label], [r for r in out if not r.label]
    assert sum(r.toxic for r in toxic) / len(toxic) > 0.9
    assert sum(r.toxic for r in clean) / len(clean) < 0.005
    assert np.mean([r.severity for r in toxic]) > 1 > np.mean([r.severity for r in clean])


def test_fit_orders_grades():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 4, 400)
    rows, columns = [], []
    for i, g in enumerate(grades):
        for c in range(g):
            rows.append(i)
            columns.append(c)
    w, t = toxicity.fit(np.array(rows), np.array(columns), grades, 3)
    assert (np.diff(t) > 0).all() and (w > 0).all()
    score = np.bincount(rows, w[columns], len(grades))
    expected = sum(1 / (1 + np.exp(k - score)) for k in t)
    assert np.corrcoef(expected, grades)[0, 1] > 0.95


def test_gradient_step_lowers_loss():
    grades = np.array([0, 0, 1, 2, 3])
    w, t = toxicity.fit(np.array([2, 3, 3, 4, 4, 4]), np.array([0, 0, 1, 0, 1, 2]), grades, 3)
    score = np.bincount([2, 3, 3, 4, 4, 4], w[[0, 0, 1, 0, 1, 2]], 5)
    p = np.diff(np.concatenate([np.zeros((5, 1)), 1 / (1 + np.exp(-(t[None] - score[:, None]))), np.ones((5, 1))], axis=1), axis=1)
    assert (p.argmax(axis=1) == grades).all()


@pytest.fixture(scope="module")
def small(spark):
    docs = [(i, f"plain words number {i} and more {i * 7}") for i in range(150)] + [(i, f"plain badword text {i} of {i * 3} horrible") for i in range(150, 200)]
    labels = [(i, 0, int(i >= 150)) for i in range(200)] + [(150, 0, None), (None, 0, 1), (151, 0, 0), (999, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_odd_documents(small, odd_docs, no_docs):
    model = toxicity.learn(*small)
    assert "=badword@1" in model.weights
    rows = toxicity.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and not any(r.toxic for r in rows)
    assert toxicity.drop_toxic(odd_docs, model).columns == odd_docs.columns
    assert toxicity.drop_toxic(small[0], model).count() == 150
    assert toxicity.score(no_docs, model).count() == 0


def test_nothing_to_learn(small, no_docs, odd_docs):
    for model in (toxicity.learn(no_docs, small[1]), toxicity.learn(small[0], small[1].where("toxic = 0")), toxicity.learn(small[0], small[1].limit(0))):
        assert {r.severity for r in toxicity.score(odd_docs, model).collect()} == {0.0}


def test_few_labels_and_rare_words(spark):
    """Words of 4 toxic texts each, at toxic shares of 10, 50 and 70 percent."""
    fill = "amber birch cedar delta ember fjord grove heath inlet jetty kelp lagoon".split()
    bad = "vile rotten hateful nasty".split()
    for clean in (144, 16, 7):
        plain = [[fill[(i * k) % 12] + fill[(i + 3 * k) % 12] for k in range(1, 6)] for i in range(16 + clean)]
        texts = [" ".join([bad[i % 4]] * (i < 16) + words) for i, words in enumerate(plain)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        labels = spark.createDataFrame([(i, int(i < 16)) for i in range(len(texts))], "doc_id long, toxic int")
        tried = spark.createDataFrame([(0, "some vile thing"), (1, "some nasty thing"), (2, "some fine thing")], "doc_id long, text string")
        model = toxicity.learn(docs, labels)
        assert {r.doc_id: r.toxic for r in toxicity.score(docs, model).collect()} == {i: i < 16 for i in range(len(texts))}
        assert [r.severity > 0 for r in toxicity.score(tried, model).collect()] == [True] * 3
        got = {r.doc_id: r.p_toxic for r in toxicity.score(tried, model).collect()}
        assert min(got[0], got[1]) > got[2]


def test_few_labels_of_the_smallest_table(spark):
    docs, labels = (queries.table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "labels"))
    label = {r.doc_id: r.toxic for r in labels.collect()}
    gone = {r.doc_id for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect() if r.toxic}
    assert {i for i, t in label.items() if t} <= gone and not any(label.get(i) == 0 for i in gone)


def test_long_clean_texts_do_not_gain(spark):
    """One bad beginning that clean words share, in ever longer clean texts."""
    docs = [(i, f"clowns{i} show" if i < 20 else " ".join(["clothes"] * (i % 5 == 0) + [f"word{i * 7 + k}" for k in range(i % 40 + 3)])) for i in range(220)]
    labels = [(i, int(i < 20)) for i in range(220)]
    model = toxicity.learn(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert not any(f.startswith("3") for f in model.weights) and min(model.weights.values()) < 0
    long = spark.createDataFrame([(0, "cloth clock cloud clothes " + " ".join(f"other{k} thing{k}" for k in range(5000)))], "doc_id long, text string")
    assert not toxicity.score(long, model).first().toxic
