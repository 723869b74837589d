import os
import re
from concurrent.futures import ThreadPoolExecutor
from hashlib import md5
from threading import Barrier

import numpy as np
import pandas as pd
import pytest

from normtrace.operators import benchmark as bm
from normtrace.operators import models as md
from normtrace.operators import scoring, similarity as sm
from normtrace.operators import universes as un
from normtrace.session import shared_folder


def make_loader():
    """Nested, so that the loader travels to the workers by value."""
    def loader():
        calls = {}

        def model(prompt):
            calls[prompt] = calls.get(prompt, 0) + 1
            if prompt == "bad":
                raise ValueError("no way")
            if prompt == "limited" or (prompt == "once" and calls[prompt] == 1):
                raise RuntimeError("Error code: 429")
            return {"text": f" {prompt}! " if prompt != "blank" else " ", "prompt_tokens": len(prompt),
                    "completion_tokens": 2, "total_tokens": len(prompt) + 2, "finish_reason": "stop"}

        return model

    return loader


loader = make_loader()


def test_generate_with_metrics(spark):
    df = spark.createDataFrame([(1, "hi"), (2, "bad"), (3, "once")], "id int, prompt string")
    got = {r["id"]: r for r in md.generate_flat(df, "prompt", loader).collect()}
    assert (got[1]["text"], got[1]["prompt_tokens"], got[1]["status"]) == ("hi!", 2, md.SUCCESS)
    assert got[1]["latency_s"] >= 0
    assert (got[2]["text"], got[2]["total_tokens"], got[2]["status"]) == (None, None, "Erreur: no way")
    assert "429" in got[3]["status"]


def test_long_prompts_are_asked_a_few_at_a_time(spark):
    """A worker holds the answers to about a million characters of prompts at once, whatever an Arrow batch brings."""
    parts = list(md._slices(pd.Series(["abc", None, "", "defg", "h" * 9, "i"]), 4))
    assert [list(p.fillna("null")) for p in parts] == [["abc", "null", ""], ["defg"], ["h" * 9, "i"]] and len(list(md._slices(pd.Series([], dtype=str), 4))) == 1

    class Lists:
        def batch(self, prompts):
            return [{"text": f"{p[:2]} {len(prompts)}"} for p in prompts]

    df = spark.range(10, numPartitions=1).selectExpr("id", "CASE WHEN id <> 4 THEN concat(lpad(id, 2, '0'), repeat('x', 400000)) END AS prompt")
    got = {r["id"]: r["text"] for r in md.generate_flat(df, "prompt", lambda: Lists()).collect()}
    assert got[4] is None and all(got[i].startswith(f"{i:02d} ") and int(got[i].split()[1]) <= 3 for i in range(10) if i != 4)


def test_retries_and_upsert(spark):
    old = spark.createDataFrame(
        [(1, "kept", md.SUCCESS), (2, None, "Erreur: 429"), (3, None, None), (4, None, "Erreur: x")],
        "id int, text string, status string")
    prompts = spark.createDataFrame([(1, "hi"), (2, "limited"), (3, "once"), (4, "bad")], "id int, prompt string")
    todo = md.unsuccessful(old)
    assert {r["id"] for r in todo.collect()} == {2, 3, 4}
    again = md.generate_flat(todo.select("id").join(prompts, "id").coalesce(1), "prompt", loader, tries=3, pause=0.0)
    got = {r["id"]: (r["text"], r["status"]) for r in md.upsert(old, again, ["id"]).collect()}
    assert got == {1: ("kept", md.SUCCESS), 2: (None, "Erreur: 429"), 3: ("once!", md.SUCCESS), 4: (None, "Erreur: no way")}


def test_extraction_and_explanation(spark):
    df = spark.createDataFrame([(1, "hi"), (2, "bad"), (3, None), (4, " \n"), (5, "blank")], "id int, text string")
    got = {r["id"]: r["extraction"] for r in md.extract_triplets(df, "text", loader).collect()}
    assert got == {1: "hi!", 2: "Erreur d'extraction : no way", 3: md.NO_TEXT, 4: md.NO_TEXT, 5: ""}
    told = {r["id"]: r["explanation"] for r in md.explain(df.where("id IN (1, 2, 5)"), "text", loader).collect()}
    assert told == {1: "hi!", 2: md.EMPTY_REPORT, 5: md.EMPTY_REPORT}


GENERATIONS = "model string, latency_s double, completion_tokens int, status string"


def test_comparison(spark):
    df = spark.createDataFrame([
        ("a", 1.0, 10, md.SUCCESS), ("a", 2.0, None, "Erreur: x"), ("a", None, None, None),
        ("b", 4.0, 20, md.SUCCESS), ("c", 1.0, 5, md.SUCCESS)], GENERATIONS)
    summary = {r["model"]: tuple(r)[1:] for r in bm.model_summary(df).collect()}
    assert summary["a"] == (3, 1, 2, 33.33, 1.5, 10.0)
    assert [r["model"] for r in bm.leaderboard(bm.model_summary(df)).collect()] == ["c", "b", "a"]
    shares = {(r["model"], r["status"]): r["pct"] for r in bm.status_distribution(df).collect()}
    assert shares[("a", md.SUCCESS)] == 50.0 and len(shares) == 4
    assert tuple(bm.corpus_stats(df).first()) == (5, 2.0, pytest.approx(35 / 3))
    assert {r["model"]: r["ratio"] for r in bm.success_ratio(df, ["model"]).collect()}["a"] == pytest.approx(1 / 3)


def plain_selection(fact, states, lam, floor):
    sims = np.array([0.0 if not np.linalg.norm(fact) or not np.linalg.norm(u) else
                     float(fact @ u / (np.linalg.norm(fact) * np.linalg.norm(u))) for u in states])
    if sims.std() < 1e-6:
        best = int(sims.argmax())
        return {best} if sims[best] >= floor else set()
    return {i for i, s in enumerate(sims) if s >= sims.mean() + lam * sims.std() and s >= floor}


@pytest.mark.parametrize("lam, floor", [(0.5, 0.2), (0.8, 0.2), (0.8, -1.0)])
def test_projection(spark, lam, floor):
    rng = np.random.default_rng(7)
    norms = {n: rng.normal(size=(n + 1, 6)) for n in range(4)}
    norms[4] = np.ones((3, 6))
    facts = [(n, i, rng.normal(size=6) + (0.5 if i % 2 else 0)) for n in norms for i in range(30)]
    facts.append((4, 99, np.zeros(6)))
    odd = [(0, 200, None), (1, 201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (77, 202, [1.0] * 6)]
    states = spark.createDataFrame([(n, i, f"s{i}", u.tolist()) for n, us in norms.items() for i, u in enumerate(us)],
                                   "norm_id bigint, u_pos int, state_id string, vector array<double>")
    df = spark.createDataFrame([*[(n, i, f.tolist()) for n, i, f in facts], *odd], "norm_id bigint, fact bigint, vector array<double>")
    universe = sm.norm_universe(states)
    want = {(n, i): plain_selection(f, norms[n], lam, floor) for n, i, f in facts}
    for found in (sm.project(df, universe, lam=lam, floor=floor),
                  sm.project_batched(df, universe, lam=lam, floor=floor),
                  sm.project_batched(df, universe, lam=lam, floor=floor, facts_per_group=7),
                  un.project_pruned(df, un.index_states(states, 2), lam=lam, floor=floor, per_group=7)):
        got = {}
        for r in found.collect():
            got.setdefault((r["norm_id"], r["fact"]), set()).add(r["u_pos"])
        assert got == {k: v for k, v in want.items() if v}


def test_pruned_search_of_a_large_norm(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(20, 8))
    us = np.concatenate([centres[rng.integers(20, size=3000)] + 0.05 * rng.normal(size=(3000, 8)), np.zeros((1, 8))])
    states = spark.createDataFrame([(1, i, f"s{i}", u.tolist()) for i, u in enumerate(us)] + [(2, 0, "a", [1.0]), (2, 1, "b", [1.0, 2.0]), (3, 0, "c", None)],
                                   "norm_id bigint, u_pos int, state_id string, vector array<double>")
    fs = centres[rng.integers(20, size=60)] + 0.05 * rng.normal(size=(60, 8))
    rows = [(1, i, f.tolist()) for i, f in enumerate(fs)] + [(1, 100 + i, fs[0].tolist()) for i in range(40)] + [(2, 500, [1.0]), (3, 501, [1.0]), (1, 502, [1.0]), (None, 503, [1.0])]
    facts = spark.createDataFrame(rows, "norm_id bigint, u_pos bigint, vector array<double>").withColumnRenamed("u_pos", "key")
    index = un.index_states(states, 100)
    got = {}
    for r in un.project_pruned(facts, index, lam=2.0, floor=0.2, per_group=16).collect():
        got.setdefault(r["key"], set()).add(r["u_pos"])
    assert got == {i: plain_selection(np.array(f), us, 2.0, 0.2) for n, i, f in rows if n == 1 and len(f) == 8}
    n_blocks = index.blocks.count()
    opened = un.open_blocks(facts.where("norm_id = 1 AND size(vector) = 8").select("norm_id", sm.F.col("key").cast("string").alias("key"), un._unit("vector").alias("vector")), index, 2.0, 0.2).count()
    assert opened < 0.6 * 100 * n_blocks  # bounds leave whole blocks shut
    assert un.project_pruned(facts.limit(0), index).count() == 0 and un.project_pruned(facts, un.index_states(states.limit(0))).count() == 0


def test_calls_are_taken_by_threads():
    """No task per prompt; several calls run at a time, answers stand in order, failures at their place."""
    submitted = []

    class Pool(ThreadPoolExecutor):
        def submit(self, *args, **kwargs):
            submitted.append(1)
            return super().submit(*args, **kwargs)

    together = Barrier(4, timeout=20)

    def model(prompt):
        if prompt < "p0004":
            together.wait()  # the first four are out at the same time
        if prompt == "p0500":
            raise ValueError("down")
        return {"text": prompt.upper()}

    prompts = [f"p{i:04d}" for i in range(1000)]
    with Pool(4) as pool:
        rows = md._call_all(model, prompts, pool)
        assert md._call_all(model, [], pool) == []
    assert [r["text"] for r in rows] == [None if p == "p0500" else p.upper() for p in prompts]
    assert rows[500]["status"] == "Erreur: down" and len(submitted) <= 4


def test_pruned_search_writes_no_pairs(spark, monkeypatch):
    """All states are near enough: rows are found by the hundred thousand, and what is written does not grow with them."""
    monkeypatch.setattr(un, "STATES_PER_TASK", 100)
    monkeypatch.setattr(un, "FACTS_PER_ROW", 16)
    rng = np.random.default_rng(5)
    us, fs = rng.normal(size=(500, 8)), rng.normal(size=(400, 8))
    states = [(1, i, f"s{i}", u.tolist()) for i, u in enumerate(us)] + [(2, i, f"t{i}", us[0].tolist()) for i in range(150)]
    index = un.index_states(spark.createDataFrame(states, "norm_id bigint, u_pos int, state_id string, vector array<double>"), 40)
    facts = [(1, i, f.tolist()) for i, f in enumerate(fs)] + [(1, 1000 + i, fs[0].tolist()) for i in range(200)] + [(2, 2000 + i, fs[i].tolist()) for i in range(5)]
    written = lambda: sum(os.path.getsize(f"{d}/{x}") for d, _, names in os.walk(shared_folder(spark).removeprefix("file:")) for x in names)
    before = written()
    found = un.project_pruned(spark.createDataFrame(facts, "norm_id bigint, fact bigint, vector array<double>"), index, lam=-9.0, floor=-2.0, per_group=64)
    got = found.groupBy("norm_id", "fact").agg(sm.F.count("*").alias("n"), sm.F.countDistinct("u_pos").alias("d"), sm.F.min("u_pos").alias("first")).collect()
    assert sorted(map(tuple, got)) == sorted((n, i, *((500, 500, 0) if n == 1 else (1, 1, 0))) for n, i, _ in facts)
    assert written() - before < 2_000_000


def test_embedding(spark):
    df = spark.createDataFrame([(1, "A b a"), (2, ""), (3, None)], "id int, text string")
    hashed = {r["id"]: r["vector"] for r in sm.hash_embed(df, ["id"], "text", 8).collect()}
    assert sum(hashed[1]) == 3 and max(hashed[1]) >= 2 and sum(hashed[2]) == sum(hashed[3]) == 0

    texts = ["Été_1 été_1 ½ x-y", "a " * 5000 + "b", "-", "\n", "ÄÖ 数 数 ٣", "x"]
    odd = spark.createDataFrame([(i, t, "other", 0) for i, t in enumerate(texts)] + [(5, "x", "other", 0)], "id int, text string, vector string, bucket int")
    for dims in (1, 7, 300):
        want = []
        for i, t in [*enumerate(texts), (5, "x")]:
            counts = [0.0] * dims
            for word in re.findall(r"\w+", t.lower()):
                counts[int(md5(word.encode()).hexdigest()[:8], 16) % dims] += 1
            want.append((i, counts))
        assert sorted(map(tuple, sm.hash_embed(odd, ["id"], "text", dims).collect())) == sorted(want)

    def embedder():
        return lambda texts: np.array([[len(t), t.count("a")] for t in texts])

    got = {r["id"]: r["vector"] for r in sm.embed_text(df, "text", embedder).collect()}
    assert got == {1: [5.0, 1.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}


def test_macro_gate(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, macro_conformance boolean")
    go, stop = scoring.macro_gate(df)
    assert {r["id"] for r in go.collect()} == {1, 3} and [r["id"] for r in stop.collect()] == [2]
