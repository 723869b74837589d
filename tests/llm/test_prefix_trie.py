"""Prefix trie: nodes by definition, at any number of shards, with hot sequences and odd rows."""

import hashlib
import random
import zlib

import pytest

from normtrace.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, ids string, n double"


def plain(sequences):
    """All nodes of ``{conv_id: [(turn key, bytes), …]}``."""
    nodes = {}
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(t for t, _ in turns[:d]), {"members": set(), "ends": [], "bytes": turns[d - 1][1] if d else 0})["members"].add(conv)
        nodes[tuple(t for t, _ in turns)]["ends"].append(conv)
    out = []
    for path, node in nodes.items():
        below = [(p, x) for p, x in nodes.items() if p[:len(path)] == path]
        kids = [p for p, _ in below if len(p) == len(path) + 1]
        leaves = sum(not any(len(q) > len(p) and q[:len(p)] == p for q, _ in below) for p, _ in below)
        out.append((min(node["members"]), len(path), min(nodes[path[:-1]]["members"]) if path else None, len(node["members"]), len(kids), leaves,
                    sum((len(x["members"]) - 1) * x["bytes"] for _, x in below), hashlib.sha256(",".join(map(str, sorted(node["ends"]))).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations_of(rows):
    """Rebuilt conversations of ``(conv_id, turn, role, text)`` rows, as the contract words it."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest, len(text.encode())))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    return out


def found(frame):
    return sorted((tuple(r) for r in frame.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


@pytest.mark.parametrize("shard_turns", [1, 7, 60, pt.SHARD_TURNS])
def test_random_sequences_at_any_number_of_shards(spark, shard_turns):
    rng = random.Random(shard_turns)
    sequences = {c: [rng.randrange(3) for _ in range(rng.randrange(7))] for c in range(150)}
    sequences.update({1000 + c: [1, 1, 2] for c in range(200)})  # one sequence on most of the rows
    rows = [(c, ids, [10 + i for i in ids]) for c, ids in sequences.items()]
    frame = spark.createDataFrame(rows, "conv_id long, ids array<long>, bytes array<long>").repartition(3)
    assert found(pt.trie_nodes(frame, shard_turns)) == plain({c: [(i, 10 + i) for i in ids] for c, ids in sequences.items()})


@pytest.mark.parametrize("shard_turns", [2, pt.SHARD_TURNS])
def test_odd_conversations(spark, shard_turns):
    long = "lang é " * 20_000
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", None), (0, 2, None, "x"), (1, None, "user", "first"), (1, 0, "user", "hi"), (2, 5, "user", "hi"), (2, 5, "user", "hi"), (2, 5, "a", "tie"),
            (None, 0, "user", "lost"), (None, None, None, None), (7, None, None, None), (11, 3, "user", long), (12, 3, "user", long), (13, 0, "us", "erhi"), (14, 0, "user", "hi"), (-3, 0, "user", "hi")]
    rows += [(20 + c, t, "user", f"{t % 2}") for c in range(9) for t in range(c)]
    frame = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], SCHEMA).repartition(3)
    want = conversations_of([r for r in rows if r[0] is None or r[0] >= 0])
    h = zlib.crc32(b"-3") % 9
    below = {-3: want[0][:h] + [(hashlib.sha256(b"4:userhi").digest(), 2)][h:]}  # -3 mod 5 is -3 in SQL
    assert found(pt.conversation_trie(frame, shard_turns)) == plain({**want, **below})


def test_no_conversations(spark):
    assert pt.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert pt.conversation_trie(spark.createDataFrame([(None, 1, "user", "x", "", 0.0)], SCHEMA)).count() == 0


def test_given_conversations_in_several_shards(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    want = plain(conversations_of([(r.conv_id, r.turn, r.role, r.text) for r in frame.collect()]))
    assert found(pt.conversation_trie(frame, 50)) == want


def test_medians_balance_the_tree():
    tree = pt.Tree()
    tree.insert_medians([[i] for i in range(1023)], [[1]] * 1023)
    deepest, level = 0, [tree.eq[0]]
    while level:
        deepest += 1
        level = [x for at in level for x in (tree.lo[at], tree.hi[at]) if x >= 0]
    assert deepest == 10


def test_many_members_stream_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(pt, "CHUNK_BYTES", 50)
    frame = spark.range(3000).selectExpr("id % 2 AS seq", "id AS conv_id").repartition(5)
    shas = {r.seq: r.sha for r in pt.member_digests(frame).collect()}
    assert shas == {s: hashlib.sha256(",".join(str(i) for i in range(s, 3000, 2)).encode()).hexdigest() for s in (0, 1)}
