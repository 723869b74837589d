"""Scenarios of a stream that end: state freed, late corrections, end markers, contamination from the processor."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from normtrace.operators import causal
from normtrace.plans import audit as au
from normtrace.streaming import closing as cl
from tests.test_causal import ACTS, norms_of, random_case

START = datetime(2024, 1, 1)


def minute(m):
    return None if m is None else START + timedelta(minutes=m)


def follow(spark, norms, batches, folder, **settings):
    """Each batch of ``(norm, scenario, step, u_pos, state, minute)`` in a run of its own."""
    for batch in batches:
        rows = [(*r[:5], minute(r[5])) for r in batch]
        spark.createDataFrame(rows, cl.ACTIVATIONS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(cl.ACTIVATIONS).parquet(f"{folder}/in")
        sent = cl.run_available(spark, stream, norms.links, f"{folder}/run", state_partitions=2, **settings)
    return sent


@pytest.fixture(scope="module")
def chain(spark):
    """a before b before c before d, in norm 0."""
    return norms_of(spark, [(0, "a", "b"), (0, "b", "c"), (0, "c", "d")])


def test_equals_batch_also_out_of_order(spark, tmp_path):
    edges, acts = random_case(random.Random(3), cyclic=False)
    norms = norms_of(spark, edges)
    rng = random.Random(4)
    rng.shuffle(acts)
    timed = [(*a, rng.randrange(60)) for a in acts]
    cut = len(acts) // 2
    sent = follow(spark, norms, [timed[:cut], timed[cut:], timed[:5]], str(tmp_path), idle_seconds=86400, delay="1 day")
    batch = au.audit(norms, spark.createDataFrame(acts, ACTS))
    missing = {tuple(r)[:4] + (tuple(r[4]),) for r in causal.violations(batch, norms.links).collect()}
    got = cl.latest(sent).collect()
    assert {(r.norm_id, r.scenario_id, r.step, r.state_id, tuple(r.missing)) for r in got if r.valid is False} == missing
    assert {(r.norm_id, r.scenario_id, r.state_id) for r in got if r.contaminated} == {tuple(r)[:3] for r in causal.contaminated(batch).collect()}
    assert sent.where("closed").count() == 0


def test_state_is_freed(spark, chain, tmp_path):
    """Many scenarios one after another: what is kept is that of the open ones."""
    batches = [[(0, 100 * b + i, 0, 0, "b", 600 * b + i % 60) for i in range(100)] for b in range(3)]
    sent = follow(spark, chain, batches, str(tmp_path), idle_seconds=3600, delay="10 minutes")
    kept = {r.scenario_id for r in cl.open_states(spark, f"{tmp_path}/run").collect()}
    assert kept == set(range(200, 300))
    closed = {r.scenario_id for r in sent.where("closed").collect()}
    assert closed == set(range(200))
    summary = {r.scenario_id: tuple(r)[3:] for r in cl.walk_summary(sent).collect()}
    assert summary == {i: (0, 1, 3, i < 200) for i in range(300)}


def test_end_marker_late_rows_and_new_walks(spark, chain, tmp_path):
    first = [(0, 1, 1, 0, "b", 5), (0, 1, 9, 0, None, 6),  # ends at once
             (0, 2, 1, 0, "b", 5),
             (None, None, 0, 0, "a", 5), (0, 3, 1, 0, "b", None)]
    second = [(0, 1, 0, 0, "a", 4),  # behind its end marker, within the delay
              (0, 2, 0, 0, "a", 3), (0, 9, 0, 0, "x", 17)]
    third = [(0, 9, 1, 0, "x", 40)]
    fourth = [(0, 1, 0, 0, "b", 41)]  # after the closing
    sent = follow(spark, chain, [first, second, third, fourth], str(tmp_path), idle_seconds=86400, delay="10 minutes")
    got = {}
    for r in cl.latest(sent).collect():
        got.setdefault((r.scenario_id, r.walk > 0), {})[r.state_id] = (r.valid, r.contaminated)
    clean = {"a": (True, False), "b": (True, False), "c": (None, False), "d": (None, False)}
    spoiled = {"b": (False, True), "c": (None, True), "d": (None, True)}
    assert got[1, False] == clean and got[2, False] == clean and got[3, False] == spoiled
    assert got[1, True] == spoiled and got[None, False] == {"a": (True, False)}
    assert [(r.scenario_id, r.walk) for r in sent.where("closed").collect()] == [(1, 0)]


def test_empty_stream(spark, chain, tmp_path):
    sent = follow(spark, chain, [[]], str(tmp_path))
    assert sent.count() == 0 and cl.walk_summary(sent).count() == 0


def test_scenarios_share_rows_of_state(spark, chain, tmp_path):
    """One group for all: the rows of one scenario neither touch the others nor keep them open."""
    first = [(0, i, 1, 0, "b", i % 60) for i in range(300)] + [(0, 500, 1, 0, "b", None)]
    second = [(0, 7, 0, 0, "a", 100), (0, 400, 0, 0, "a", 600)]  # 7 is heard of again, 400 makes the others late
    third = [(0, 401, 0, 0, "a", 601)]
    sent = follow(spark, chain, [first, second, third], str(tmp_path), idle_seconds=3600, delay="10 minutes", groups=1)
    assert spark.read.format("statestore").load(f"{tmp_path}/run/progress").count() == 1
    assert {r.scenario_id for r in cl.open_states(spark, f"{tmp_path}/run").collect()} == {400, 401}
    assert sorted(r.scenario_id for r in sent.where("closed").collect()) == [*range(300), 500]
    summary = {r.scenario_id: tuple(r)[3:] for r in cl.walk_summary(sent).collect()}
    assert summary == {**{i: (0, 1, 3, True) for i in range(300)}, 7: (2, 0, 0, True), 400: (1, 0, 0, False), 401: (1, 0, 0, False), 500: (0, 1, 3, True)}
