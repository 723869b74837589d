"""Hash-prefix forest: recall and exact scores against brute force, odd vectors."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from normtrace.llm import hash_forest, queries

LARGE = "/root/testdata/check_s"


def plain_search(rows, nearest=10):
    """Nearest by definition: ``{query: [(distance, vec_id), ...]}`` of usable vectors of the same width."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, a in good:
        if q % 100 == 0:
            best = out.setdefault(q, {})
            for i, b in good:
                if i != q and len(a) == len(b):
                    d = math.sqrt(((a - b) ** 2).sum())
                    best[i] = min(best.get(i, d), d)
    return {q: sorted((d, i) for i, d in best.items())[:nearest] for q, best in out.items()}


def test_recall_and_scores(spark):
    rows = [(r.vec_id, r.embedding) for r in queries.table(spark, "/root/testdata/sf0.1", "embeddings").collect()]
    vectors = {i: np.array(v, float) for i, v in rows}
    want = plain_search(rows)
    got = {}
    for r in hash_forest.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0, shard_rows=600, least=300).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
        assert r.score == pytest.approx(math.sqrt(((vectors[r.query_id] - vectors[r.vec_id]) ** 2).sum()), rel=1e-12)
    assert got.keys() == want.keys()
    for found in got.values():
        assert [f[0] for f in sorted(found)] == list(range(1, 11)) and sorted(f[1:] for f in found) == [f[1:] for f in sorted(found)]
    hits = sum(len({i for _, i in want[q]} & {i for *_, i in got[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.85  # with fewer candidates a shard than the registered query takes


def test_registered_query_recall(spark):
    if not os.path.isdir(LARGE):
        pytest.skip("no larger table here")
    rows = [(r.vec_id, r.embedding) for r in queries.table(spark, LARGE, "embeddings").collect()]
    ids, every = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    got = {}
    for r in queries.op4_hash_forest(spark, LARGE).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in got:
        d = ((every - every[ids == q][0]) ** 2).sum(axis=1)
        d[ids == q] = np.inf
        hits += len(got[q] & set(ids[np.argsort(d, kind="stable")[:10]].tolist()))
    assert hits / (10 * len(got)) >= 0.9


@pytest.mark.parametrize("clusters", [0, 60])
def test_recall_at_production_parameters(spark, clusters):
    """More vectors than one shard compares, random or in tight clusters, by the settings of the registered query."""
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((12000, 32))
    if clusters:
        vectors = rng.standard_normal((clusters, 32))[rng.integers(0, clusters, len(vectors))] + 0.05 * vectors
    vectors = vectors.astype(np.float32)
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<float>")
    got = {}
    for r in hash_forest.nearest_neighbours(frame, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    every, hits = vectors.astype(float), 0
    for q in range(0, len(every), 100):
        d = ((every - every[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits / (10 * len(got)) >= 0.9


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [1.0, 0.1]), (2, [1.0, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]),
            (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 2.0, 3.0]), (100, [3.0, 2.0, 1.0]), (None, [1.0, 1.0]), (200, None), (300, [0.0, 0.0])]
    frame = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<float>, shard string, rank int")
    got = {}
    for r in hash_forest.nearest_neighbours(frame, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    want = plain_search([(i, [np.float32(x) if x is not None else None for x in v] if v is not None else None) for i, v in rows])
    assert {q: [i for _, i in f] for q, f in got.items()} == {q: [i for _, i in f] for q, f in want.items()} == {0: [1, 2], 100: [9]}
    assert hash_forest.nearest_neighbours(frame.where("vec_id < -1"), F.lit(True)).count() == 0


def test_many_equal_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(500)] + [(i, [float(i), 1.0, 0.0]) for i in range(500, 600)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = hash_forest.nearest_neighbours(frame, F.col("vec_id") == 100, shard_rows=200, least=10).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(i, 0.0) for i in range(10)]
