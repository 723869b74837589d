"""The set-based causal check against a walk that does one step after the other."""

import random

import pytest
from pyspark.sql import functions as F

from normtrace.operators import causal, graph, scoring
from normtrace.plans import audit as au
from normtrace.plans.normative import norm_summary, norms_from_edges
from normtrace.streaming import incremental as inc

ACTS = "norm_id bigint, scenario_id bigint, step int, u_pos int, state_id string"
EDGES = "norm_id bigint, source string, target string"


def walk(acts, pres, succs):
    """Plain restatement: acts is a list of (step, u_pos, state)."""
    valid, bad, found = set(), set(), []
    for step, _, state in sorted(acts):
        if state in bad:
            continue
        missing = pres.get(state, set()) - valid
        if missing:
            bad.add(state)
            found.append((step, state, tuple(sorted(missing))))
        else:
            valid.add(state)
    queue = list(bad)
    while queue:
        for nxt in succs.get(queue.pop(), ()):
            if nxt not in bad:
                bad.add(nxt)
                queue.append(nxt)
    return valid, found, bad


def random_case(rng, cyclic):
    edges, acts = [], []
    for norm in range(12):
        names = [f"s{i}" for i in range(rng.randint(2, 8))]
        for a in names:
            for b in names:
                if (a != b if cyclic else a < b) and rng.random() < 0.25:
                    edges.append((norm, a, b))
        for scenario in range(8):
            for step in range(rng.randint(0, 12)):
                for pos, state in enumerate(rng.sample(names + ["other"], rng.randint(0, 2))):
                    acts.append((norm, scenario, step, pos, state))
    return edges, acts


def expected(edges, acts):
    out = {}
    for norm, scenario in {a[:2] for a in acts}:
        pres, succs = {}, {}
        for n, s, t in edges:
            if n == norm:
                pres.setdefault(t, set()).add(s)
                succs.setdefault(s, set()).add(t)
        out[norm, scenario] = walk([a[2:] for a in acts if a[:2] == (norm, scenario)], pres, succs)
    return out


def norms_of(spark, edges):
    edge_df = spark.createDataFrame(edges, EDGES)
    states = edge_df.select("norm_id", F.col("target").alias("state_id")).distinct()
    return norms_from_edges(states, edge_df)


def check(spark, edges, acts):
    norms = norms_of(spark, edges)
    decisions = au.audit(norms, spark.createDataFrame(acts, ACTS)).cache()
    want = expected(edges, acts)
    assert {tuple(r) for r in causal.validated(decisions).select("norm_id", "scenario_id", "state_id").collect()} == {
        (*k, s) for k, (valid, _, _) in want.items() for s in valid}
    got = {(r[0], r[1], r[2], r[3], tuple(r[4])) for r in causal.violations(decisions, norms.links).collect()}
    assert got == {(*k, *v) for k, (_, found, _) in want.items() for v in found}
    assert {tuple(r)[:3] for r in causal.contaminated(decisions).collect()} == {
        (*k, s) for k, (_, _, bad) in want.items() for s in bad}
    weights = {}
    for n, s, t in edges:
        weights[n, s] = weights.get((n, s), 0) + 1
        weights.setdefault((n, t), 0)
    for r in scoring.score(decisions).collect():
        mine = [a for a in acts if a[:2] == (r["norm_id"], r["scenario_id"])]
        bad = want[r["norm_id"], r["scenario_id"]][2]
        total = sum(weights.get((a[0], a[4]), 1) for a in mine)
        sound = sum(weights.get((a[0], a[4]), 1) for a in mine if a[4] not in bad)
        assert (r["total_weight"], r["compliant_weight"]) == (total, sound)
        assert r["score"] == (1.0 if total == 0 else round(sound / total, 4))
    decisions.unpersist()
    return norms


def test_acyclic_random(spark):
    check(spark, *random_case(random.Random(1), cyclic=False))


def test_cyclic_random(spark):
    check(spark, *random_case(random.Random(2), cyclic=True))


def test_same_step_counts_at_once(spark):
    edges = [(0, "a", "b")]
    check(spark, edges, [(0, 0, 0, 0, "a"), (0, 0, 0, 1, "b"), (0, 1, 0, 0, "b"), (0, 1, 0, 1, "a"), (0, 1, 5, 0, "b")])


def test_empty_scenarios_score_one(spark):
    norms = norms_of(spark, [(0, "a", "b")])
    acts = spark.createDataFrame([(0, 1, 0, 0, "b"), (0, 2, 0, 0, "a")], ACTS)
    scenarios = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "norm_id bigint, scenario_id bigint")
    got = {r["scenario_id"]: (r["score"], r["evaluated"]) for r in scoring.score(au.audit(norms, acts), scenarios).collect()}
    # 1 holds only a sink, whose weight is 0
    assert got == {1: (1.0, True), 2: (1.0, True), 3: (1.0, False)}


def test_traces(spark):
    norms = norms_of(spark, [(0, "a", "b"), (0, "b", "c")])
    acts = spark.createDataFrame([(0, 0, 1, 0, "b"), (0, 0, 1, 1, "a"), (0, 0, 3, 0, "c")], ACTS)
    facts = spark.createDataFrame([(0, 0, i) for i in range(5)], "norm_id bigint, scenario_id bigint, step int")
    decisions = au.audit(norms, acts)
    steps = [tuple(r)[2:] for r in causal.step_trace(facts, decisions).orderBy("step").collect()]
    assert steps == [(0, 0, 0, 0), (1, 1, 1, 1), (2, 1, 1, 0), (3, 1, 2, 1), (4, 1, 2, 0)]
    shown = {(r["step"], r["state_id"]): r["missing_after_step"] for r in
             causal.activation_trace(acts, decisions, norms.links).collect()}
    # b was a violation, yet its precondition a is there once the step is over
    assert shown == {(1, "b"): [], (1, "a"): [], (3, "c"): ["b"]}
    found = {r["attempted_state"]: r["missing_preconditions"] for r in causal.violations(decisions, norms.links).collect()}
    assert found == {"b": ["a"], "c": ["b"]}
    cover = causal.coverage(facts, acts).first()
    assert (cover["n_facts"], cover["n_active"]) == (5, 2)


@pytest.mark.parametrize("steps_per_block", [1, 7, 65_536])
def test_step_trace_of_long_scenarios(spark, steps_per_block):
    rng = random.Random(5)
    facts, decided = [], []
    for scenario in (None, 1, 2, 3):
        facts += [(0, scenario, step) for step in sorted(rng.sample(range(400), 120))] if scenario != 3 else []
        places = rng.sample([step for _, s, step in facts if s == scenario] or [4], 40 if scenario in (None, 1) else 1)
        decided += [(0, scenario, f"s{i}", step, True, rng.random() < 0.4) for i, step in enumerate(places * 2)]
        decided.append((0, scenario, "downstream", None, False, True))
    facts += [(9, 1, 5), (0, 1, facts[130][2])]  # no decisions; a repeated row
    keys = "norm_id bigint, scenario_id bigint"
    got = causal.step_trace(
        spark.createDataFrame(facts, f"{keys}, step int"),
        spark.createDataFrame(decided, f"{keys}, state_id string, first_step int, activated boolean, contaminated boolean"), steps_per_block)
    want = []
    for norm, scenario, step in facts:
        own = [d for d in decided if d[:2] == (norm, scenario) and d[4]]
        bad = [d[3] for d in own if d[5]]
        want.append((norm, scenario, step, sum(d[3] <= step and not d[5] for d in own), sum(b <= step for b in bad), bad.count(step)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_activation_trace_equals_a_walk(spark):
    rng = random.Random(6)
    names = [f"s{i}" for i in range(12)]
    edges = [(0, a, b) for i, a in enumerate(names) for b in names[i + 1:] if rng.random() < 0.25]
    norms = norms_of(spark, edges)
    rows = [(0, s, step, 0, rng.choice(names)) for s in range(6) for step in range(40)] + [(0, 7, 0, 0, "unknown")]
    acts = spark.createDataFrame(rows, ACTS)
    decisions = au.audit(norms, acts)
    since = {(r.scenario_id, r.state_id): r.first_step for r in causal.validated(decisions).collect()}
    got = {tuple(r)[1:5]: r.missing_after_step for r in causal.activation_trace(acts, decisions, norms.links).collect()}
    assert got == {
        (s, step, 0, state): sorted(a for _, a, b in edges if b == state and since.get((s, a), 10**9) > step)
        for _, s, step, _, state in rows}


def test_report(spark):
    norms = norms_of(spark, [(0, "a", "b"), (0, "b", "c")])
    acts = spark.createDataFrame(
        [(0, 1, 0, 0, "c"), (0, 1, 0, 1, "b"), (0, 2, 0, 0, "a"), (0, 2, 1, 0, "b")], ACTS)
    scenarios = spark.createDataFrame([(0, 1, 1, "one"), (0, 2, 2, "two"), (0, 3, 3, "three")],
                                      "norm_id bigint, scenario_id bigint, scenario_pos int, scenario string")
    results = au.scenario_results(au.audit(norms, acts), norms.links, scenarios).cache()
    rows = {r["scenario"]: r for r in au.with_violation_text(results).collect()}
    assert [tuple(v) for v in rows["one"]["violations"]] == [(0, "c", ["b"]), (0, "b", ["a"])]
    assert rows["one"]["violations_text"].splitlines()[1].endswith("'b' but missing prerequisites: [a]")
    assert rows["one"]["contaminated_states"] == ["b", "c"] and rows["one"]["verdict"] == "fail"
    assert (rows["two"]["score"], rows["two"]["n_validated"], rows["two"]["violations"]) == (1.0, 2, [])
    assert (rows["three"]["score"], rows["three"]["evaluated"]) == (1.0, False)
    summary = norm_summary(norms.states, norms.edges)
    for nested, count in ((True, 1), (False, 3)):
        docs = au.report_documents(results, summary, nested=nested).collect()
        assert len(docs) == count
        assert sorted(s["scenario"] for d in docs for s in d["scenarios"]) == ["one", "three", "two"]
        assert all(d["normative_reference"]["nb_edges"] == 2 and d["average_score"] == round(2 / 3, 4) for d in docs)
    assert [s["scenario"] for s in au.report_documents(results, summary, nested=True).first()["scenarios"]] == ["one", "two", "three"]
    assert au.audit_report(results, summary).count() == 3


def test_errors_stay_out_of_the_mean(spark):
    results = spark.createDataFrame(
        [(0, 1, 0.5, None), (0, 2, 0.9, "boom"), (1, 1, 0.2, "boom")],
        "norm_id bigint, scenario_id bigint, score double, error string")
    got = {r["norm_id"]: (r["n_scenarios"], r["n_valid"], r["average_score"]) for r in scoring.average_score(results).collect()}
    assert got == {0: (2, 1, 0.5), 1: (1, 0, None)}


def test_stream_equals_batch_also_out_of_order(spark, tmp_path):
    edges, acts = random_case(random.Random(3), cyclic=False)
    norms = norms_of(spark, edges)
    rng = random.Random(4)
    rng.shuffle(acts)
    path = str(tmp_path / "in")
    cut = len(acts) // 2
    for part in (acts[:cut], acts[cut:]):  # the second run goes on from the state of the first
        spark.createDataFrame(part, ACTS).repartition(2).write.mode("append").parquet(path)
        stream = spark.readStream.schema(inc.ACTIVATIONS).option("maxFilesPerTrigger", 1).parquet(path)
        sent = inc.run_available(spark, stream, norms.links, str(tmp_path / "state"))
    got = inc.latest(sent).cache()
    batch = au.audit(norms, spark.createDataFrame(acts, ACTS))
    missing = {tuple(r)[:4] + (tuple(r[4]),) for r in causal.violations(batch, norms.links).collect()}
    mine = {(r["norm_id"], r["scenario_id"], r["step"], r["state_id"], tuple(r["missing"]))
            for r in got.where("NOT valid").collect()}
    assert mine == missing
    down = {tuple(r) for r in inc.downstream(got, norms.reach).collect()}
    assert down == {tuple(r)[:3] for r in causal.contaminated(batch).collect()}


def closure(edges):
    """All pairs by walking from every vertex."""
    out = {}
    for norm, source, target in edges:
        if source is not None and target is not None:
            out.setdefault((norm, source), set()).add(target)
    found = set()
    for norm, start in out:
        open_ = [start]
        while open_:
            for end in out.get((norm, open_.pop()), ()):
                if (norm, start, end) not in found:
                    found.add((norm, start, end))
                    open_.append(end)
    return found


def test_reach_equals_walk(spark):
    for seed, cyclic in ((5, True), (6, False), (7, True)):
        edges, _ = random_case(random.Random(seed), cyclic=cyclic)
        edges = [*edges, (0, None, "x"), (0, "x", None), (1, None, None), *edges[:2]]
        got = [tuple(r) for r in graph.reachability(spark.createDataFrame(edges, EDGES)).collect()]
        assert set(got) == closure(edges) and len(got) == len(set(got))
    assert graph.reachability(spark.createDataFrame([], EDGES)).count() == 0


def test_reach_of_a_long_chain_beside_small_norms(spark):
    chain = [(-1, f"v{i:03d}", f"v{i + 1:03d}") for i in range(300)]
    small = [(n, a, b) for n in range(50) for a, b in (("a", "b"), ("b", "c"), ("c", "a"))]
    got = graph.reachability(spark.createDataFrame([*chain, *small], EDGES))
    assert {r["norm_id"]: r["count"] for r in got.groupBy("norm_id").count().collect()} == {-1: 300 * 301 // 2, **{n: 9 for n in range(50)}}
