"""What a task holds does not grow with the input."""

import random

from normtrace import session
from normtrace.operators import causal
from normtrace.operators import graph
from normtrace.operators import preconditions as pc
from normtrace.operators import universes as un
from normtrace.plans import audit as au
from normtrace.plans import conformance as cf
from normtrace.plans.queries import _audit_models
from normtrace.sources import files as fl
from normtrace.streaming import closing as cl
from normtrace.streaming.incremental import stream_settings
from tests.test_causal import ACTS, norms_of, random_case
from tests.test_closing import follow


def test_scenarios_are_dealt_by_rows_not_by_cores(spark, monkeypatch):
    edges, acts = random_case(random.Random(8), cyclic=False)
    norms, activations = norms_of(spark, edges), spark.createDataFrame(acts, ACTS)
    usual = causal.with_missing(au.audit(norms, activations), norms.links)
    want = sorted(map(str, usual.collect()))
    n_firsts = causal.first_activations(activations).count()
    monkeypatch.setattr(session, "ROWS_PER_TASK", 3)
    decided = au.audit(norms, activations)
    assert decided.rdd.getNumPartitions() == -(-n_firsts // 3) > 4
    missing = causal.with_missing(decided, norms.links)
    assert missing.rdd.getNumPartitions() == -(-decided.count() // 3)
    assert sorted(map(str, missing.collect())) == want


def test_a_task_takes_thousands_of_small_files(tmp_path):
    for i in range(3000):
        (tmp_path / f"{i}.txt").write_text("x")
    assert len(fl.CorpusReader({"path": str(tmp_path)}).partitions()) == 2


def test_a_vector_is_held_once_whatever_it_opens(spark):
    rng = random.Random(9)
    states = [(1, i, f"s{i}", [rng.gauss(0, 1) for _ in range(4)]) for i in range(200)]
    index = un.index_states(spark.createDataFrame(states, "norm_id bigint, u_pos int, state_id string, vector array<double>"), 10)
    asks = spark.createDataFrame([(1, str(i), [1.0, 0.0, 0.0, float(i)]) for i in range(5)], "norm_id bigint, key string, vector array<double>")
    asks = asks.select("norm_id", "key", un._unit("vector").alias("vector"))
    chosen = un._choose_blocks(asks, index, 0.5, 0.0, 4096).collect()
    pairs = {(r.key, r.block) for r in un.open_blocks(asks, index, 0.5, 0.0).collect()}
    assert len(chosen) <= 5 < len(pairs) and pairs == {(r.key, b) for r in chosen for b in r.blocks}


def test_a_scenario_is_one_row_of_state_and_keys_stay_exact(spark, tmp_path):
    norms, big = norms_of(spark, [(0, "a", "b")]), 2**53 + 1
    batch = [(0, big, 0, 0, "b", 1), (0, big, 1, 0, "a", 2), (None, None, 0, 0, "a", 1), (0, None, 0, 0, "b", 1)]
    sent = follow(spark, norms, [batch], str(tmp_path), idle_seconds=86400, delay="1 day")
    assert {(r.norm_id, r.scenario_id, r.state_id) for r in sent.collect()} == {(0, big, "a"), (0, big, "b"), (None, None, "a"), (0, None, "b")}
    with stream_settings(spark):
        assert spark.read.format("statestore").load(f"{tmp_path}/run/progress").count() == 3
    kept = {(r.norm_id, r.scenario_id, r.state_id) for r in cl.open_states(spark, f"{tmp_path}/run").collect()}
    assert kept == {(0, big, "a"), (0, big, "b"), (None, None, "a"), (0, None, "b")}


def test_norms_with_rules_are_not_sent_to_the_driver(spark):
    """Beside the parsed rules, Catalyst takes norms for far fewer bytes than they are."""
    norms = spark.range(200_000).withColumnRenamed("id", "norm_id")
    answers = session.settle(norms.selectExpr("norm_id", """'{"Pre_text": {"A:B": ["x"]}}' AS raw"""), "answers")
    states = session.settle(norms.selectExpr("norm_id", "explode(array('A:B', 'C:D')) AS state_id"), "states")
    with_rules = pc.rules_of(answers, states)
    named = with_rules.select("norm_id", "state_id")
    assert "Broadcast" not in named._jdf.queryExecution().executedPlan().toString()
    assert named.count() == 400_000 and with_rules.where("size(pres) = 1").count() == 200_000


def test_rules_are_read_from_their_answers_once(spark):
    texts = spark.createDataFrame([(n, f"text {n}") for n in range(3)], "norm_id bigint, text string")
    side = cf.build_norm_side(texts, _audit_models(), graph.default_entity_rank(spark))
    for part in (side.norms.weights, side.norms.links, side.norms.reach):
        assert "parseJson(" not in part._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.norm_id, r.state_id, r.weight) for r in side.norms.weights.collect()} == {
        (n, s, w) for n in range(3) for s, w in (("Request:Sent", 1), ("Country:Selected", 1), ("Account:Created", 0))}
