import random

import pytest
from pyspark.sql import functions as F

from normtrace.operators import cycles, graph
from normtrace.session import settle

EDGES = "norm_id bigint, source string, target string"


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([
        (0, "Request:Sent", "Country:Selected"), (0, "Request:Sent", "Country:Selected"),
        (0, "Country:Selected", "Request:Sent"), (0, "Country:Selected", "Country:Accepted"),
        (0, "Thing:A", "Other:B"), (0, "Country:Accepted", "Other:B"), (1, "Password:Created", "Account:Created"),
    ], EDGES)


def test_rank_rule(spark, edges):
    unique = graph.distinct_edges(edges)
    ranks = graph.default_entity_rank(spark)
    assert rows(graph.forward_edges(unique, ranks)) == {
        (0, "Request:Sent", "Country:Selected"), (0, "Country:Accepted", "Other:B")}
    removed = graph.back_edges(unique, ranks)
    assert rows(removed) == {
        (0, "Country:Selected", "Request:Sent"), (0, "Country:Selected", "Country:Accepted"),
        (0, "Thing:A", "Other:B"), (1, "Password:Created", "Account:Created")}
    assert rows(graph.drop_edges(unique, removed)) == rows(graph.forward_edges(unique, ranks))
    assert rows(graph.edge_audit(unique, ranks)) == {(0, 5, 3, 0, 2), (1, 1, 1, 0, 0)}


def test_weights_cover_states_and_strange_sources(spark):
    states = spark.createDataFrame([(0, "a"), (0, "b")], "norm_id bigint, state_id string")
    edges = spark.createDataFrame([(0, "a", "b"), (0, "x", "a"), (0, "x", "b")], EDGES)
    weights = graph.out_degree_weights(states, edges)
    assert rows(weights) == {(0, "a", 1), (0, "b", 0), (0, "x", 2)}
    assert [r["state_id"] for r in graph.top_weights(weights, 1).collect()] == ["x"]
    assert graph.top_weights(weights, None).count() == 2


def trim(edges):
    """Plain restatement: drop vertices without a way in or out until none is left."""
    edges = set(edges)
    while True:
        sources, targets = {e[0] for e in edges}, {e[1] for e in edges}
        kept = {(s, t) for s, t in edges if s in targets and t in sources}
        if kept == edges:
            return edges
        edges = kept


def test_cyclic_core_and_breaking(spark):
    rng = random.Random(0)
    names = [f"E{i}:s" for i in range(7)]
    given = {(n, a, b) for n in range(20) for a in names for b in names if rng.random() < 0.13}
    df = spark.createDataFrame(sorted(given), EDGES)
    core = rows(graph.cyclic_core(df))
    assert core == {(n, s, t) for n in range(20) for s, t in trim({e[1:] for e in given if e[0] == n})}
    ranks = spark.createDataFrame([(f"E{i}", i % 3) for i in range(7)], "entity string, rank int")
    flagged = rows(graph.break_cycles(df, ranks))
    assert {e[:3] for e in flagged} == given
    assert {e[:3] for e in flagged if e[3]} <= core
    for n in range(20):
        assert not trim({e[1:3] for e in flagged if e[0] == n and not e[3]})


def plain_reach(edges):
    reach = set(edges)
    while True:
        more = {(a, d) for a, b in reach for c, d in edges if b == c} - reach
        if not more:
            return reach
        reach |= more


@pytest.fixture(scope="module")
def tangled():
    rng = random.Random(7)
    names = [f"E{i}:s" for i in range(9)]
    given = {(n, a, b) for n in range(30) for a in names for b in names if rng.random() < 0.04 * (1 + n % 5)}
    return given | {(None, "a", "b"), (None, "b", "a"), (None, "b", "c"), (99, "x", "x")}


@pytest.mark.parametrize("limit", [cycles.LOCAL_EDGES, 8])
def test_components_core_and_reach_at_any_size(spark, tangled, limit):
    """All norms where their edges meet, or the larger ones in rounds."""
    df = settle(spark.createDataFrame(sorted(tangled, key=str), EDGES), "edges")
    want, core, pairs = set(), set(), set()
    for n in {e[0] for e in tangled}:
        edges = {e[1:] for e in tangled if e[0] == n}
        reach = plain_reach(edges)
        pairs |= {(n, *p) for p in reach}
        core |= {(n, *e) for e in trim(edges)}
        for v in {x for e in edges for x in e}:
            mates = {w for w in {x for e in edges for x in e} if (v, w) in reach and (w, v) in reach} | {v}
            want.add((n, v, min(mates), len(mates), (v, v) in reach))
    assert rows(cycles.cycle_components(df, limit)) == want
    assert rows(cycles.cyclic_core(df, limit)) == core
    assert rows(graph.reachability(df, settled=True, limit=limit)) == pairs


@pytest.mark.parametrize("limit", [cycles.LOCAL_EDGES, 12])
def test_cut_is_acyclic_and_minimal(spark, tangled, limit):
    df = spark.createDataFrame(sorted(tangled, key=str), EDGES)
    ranks = spark.createDataFrame([(f"E{i}", i % 4) for i in range(9)], "entity string, rank int")
    flagged = rows(graph.cut_cycles(df, ranks, limit=limit))
    assert {e[:3] for e in flagged} == tangled
    smaller = 0
    for n in {e[0] for e in tangled}:
        kept, gone = ({e[1:3] for e in flagged if e[0] == n and e[3] == removed} for removed in (False, True))
        assert not trim(kept)
        if limit == cycles.LOCAL_EDGES:
            reach = plain_reach(kept)
            assert all(s == t or (t, s) in reach for s, t in gone)
            smaller += len(trim(kept | gone)) - len(gone)
    assert limit < cycles.LOCAL_EDGES or smaller > 0


def test_witnesses_are_cycles_and_lose_their_worst_edge(spark):
    two_rings = [("A:1", "B:1"), ("B:1", "C:1"), ("C:1", "A:1"), ("C:1", "D:1"), ("D:1", "B:1"), ("D:1", "E:1")]
    df = spark.createDataFrame([(1, *e) for e in two_rings], EDGES)
    ranks = spark.createDataFrame([(x, i) for i, x in enumerate("ABCDE")], "entity string, rank int")
    found = sorted(cycles.witness_cycles(graph.rank_edges(df, ranks)).collect())
    cuts = {}
    for r in found:
        cuts.setdefault(r.cut_no, []).append(r)
    for links in cuts.values():
        assert all(a.target == b.source for a, b in zip(links, links[1:] + links[:1])) and sum(r.worst for r in links) == 1
    assert {(r.source, r.target) for r in found if r.worst and not r.put_back} == {("C:1", "A:1"), ("D:1", "B:1")}


def test_a_long_ring_and_a_long_chain(spark):
    n = 100_000
    name = lambda c: F.concat(F.lit("s"), F.lpad(c.cast("string"), 6, "0"))
    ring = spark.range(n).select(F.lit(0).cast("bigint").alias("norm_id"), name(F.col("id")).alias("source"), name((F.col("id") + 1) % n).alias("target"))
    found = cycles.cycle_components(ring).agg(F.count("*"), F.min("component_id"), F.max("component_id"), F.min("n_states")).first()
    assert tuple(found) == (n, "s000000", "s000000", n)
    assert cycles.cyclic_core(ring.where("source != 's000500'")).count() == 0


def test_no_edges(spark):
    none = spark.createDataFrame([], EDGES)
    ranks = spark.createDataFrame([("E1", 1)], "entity string, rank int")
    assert cycles.cycle_components(none).count() == graph.reachability(none).count() == graph.cyclic_core(none).count() == graph.cut_cycles(none, ranks).count() == 0
