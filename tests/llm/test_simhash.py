"""SimHash: fingerprints and components against brute force."""

import re

import numpy as np
import xxhash

from normtrace.llm import queries, simhash
from normtrace.llm.components import component_roots


def plain_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    values = sorted(set(prints))
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 3:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {v: find(i) for i, v in enumerate(values)}


def expected(rows):
    prints = [plain_fingerprint(r.text) for r in rows]
    group = plain_components(prints)
    least = {}
    for r, p in zip(rows, prints):
        if r.doc_id is not None:
            least[group[p]] = min(least.get(group[p], r.doc_id), r.doc_id)
    return sorted(((r.doc_id, f"{p:016x}", least.get(group[p])) for r, p in zip(rows, prints)), key=str)


def test_query_equals_brute_force(spark):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents").collect()
    got = queries.op1_simhash(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.select("doc_id", "fingerprint", "component_id").collect()), key=str) == expected(docs)


def test_odd_documents(odd_docs):
    got = sorted(map(tuple, simhash.near_duplicates(odd_docs).collect()), key=str)
    assert got == expected(odd_docs.collect())


def test_no_documents(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0


def test_links_lose_nothing(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 300, dtype=np.uint64)
    values = np.unique(np.concatenate([base, base ^ np.uint64(7), base[:99] ^ np.uint64(1 << 33), base[:50] ^ np.uint64(0xF0), base[:1] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))]))
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    edges = simhash.links(frame, 3, tile_rows=40)
    pairs = [(a & (2**64 - 1), b & (2**64 - 1)) for a, b in map(tuple, edges.collect())]
    assert all((a ^ b).bit_count() <= 64 for a, b in pairs) and len(pairs) < 30 * len(values)
    roots = {r.v & (2**64 - 1): r.root for r in component_roots(edges).collect()}
    want = plain_components([int(v) for v in values])
    groups = {}
    for v, g in want.items():
        groups.setdefault(g, set()).add(roots.get(v, v if v < 2**63 else v - 2**64))
    assert all(len(g) == 1 for g in groups.values())
    assert len(set().union(*groups.values())) == len(groups)


def test_tile_links_with_small_blocks():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 2**20, 200, dtype=np.uint64))
    b = np.unique(rng.integers(0, 2**20, 150, dtype=np.uint64))
    linked = {(int(x), int(y)) for x, y in simhash.tile_links(a, b, 3, rows=16)}
    near = (np.bitwise_count(a[:, None] ^ b[None]) <= 3).any(axis=1)
    assert {int(x) for x in a[near]} <= {v for pair in linked for v in pair}


def test_components_of_a_long_chain(spark):
    chain = spark.range(200).selectExpr("id AS a", "id + 1 AS b").union(spark.createDataFrame([(None, 3), (500, 500), (900, 901), (901, 900)], "a long, b long"))
    got = {r.v: r.root for r in component_roots(chain).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 901: 900}
    assert component_roots(chain.where("a < 0")).count() == 0
