"""Approximate nearest neighbours with a hash-prefix forest.

Vectors are dealt to shards of bounded size. A shard keeps, for each of several trees, the long hash
strings of its vectors as a sorted array; bit i of a string tells on which side of the i-th random
plane of that tree the vector lies. A query goes down every tree to its longest prefix match, then up
all trees in step: at each level the vectors that share a prefix of that length join the candidates,
until there are enough. Candidates are ranked by exact distance. A whole level always joins, so there
is no cap: of many equal vectors all are compared.

Queries meet every shard, in blocks: a task holds one shard and one block of queries. The best of each
shard are merged per query.

Defined results: vectors that are null, empty, all zero or hold null or non-finite numbers take no
part; vectors of different width never meet; rows of one vec_id are one candidate, at its nearest
vector, and no neighbour of themselves; a repeated query row is asked once for each different vector,
the nearest answers count; ties go to the smaller vec_id; fewer candidates than asked for give fewer
rows; rows without vec_id are left out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normtrace.session import settle_packed

NEAREST = 10
TREES = 48
BITS = 32
SHARD_ROWS = 8192
QUERY_ROWS = 4096
LEAST_CANDIDATES = 4096
SEED = 17


def planes(width: int, trees: int = TREES, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """Normals of the random planes, the same on every machine."""
    return np.random.default_rng([seed, width]).standard_normal((trees * bits, width))


class Forest:
    """Sorted arrays of hash strings over the vectors of a shard."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS):
        self.vectors, self.trees, self.bits = vectors, trees, bits
        self.normals = planes(vectors.shape[1], trees, bits)
        self.centre = vectors.mean(axis=0)
        keys = self.hashes(vectors)
        self.order = np.argsort(keys, axis=1, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, axis=1)

    def hashes(self, vectors: np.ndarray) -> np.ndarray:
        """Hash strings as numbers, one row per tree."""
        sides = ((vectors - self.centre) @ self.normals.T > 0).reshape(len(vectors), self.trees, self.bits)
        weight = np.uint64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.uint64)
        return (sides * weight).sum(axis=2, dtype=np.uint64).T

    def bounds(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each tree, query and prefix length from 0 to ``bits`` the first and last + 1 sorted position."""
        shape = (self.trees, hashes.shape[1], self.bits + 1)
        first, last = np.empty(shape, np.int32), np.empty(shape, np.int32)
        for t in range(self.trees):
            for length in range(self.bits + 1):
                low = hashes[t] >> np.uint64(self.bits - length) << np.uint64(self.bits - length)
                high = low + (np.uint64(1) << np.uint64(self.bits - length))
                first[t, :, length] = np.searchsorted(self.keys[t], low)
                last[t, :, length] = np.searchsorted(self.keys[t], high)
        return first, last

    def candidates(self, queries: np.ndarray, least: int) -> Iterator[np.ndarray]:
        """For every query the positions of at least ``least`` vectors, or of all."""
        for at in range(0, len(queries), 256):
            first, last = self.bounds(self.hashes(queries[at:at + 256]))
            for q in range(first.shape[1]):
                a, b = first[:, q], last[:, q]
                # the deepest level whose prefixes could hold enough, then up one level at a time
                for length in range(int(np.flatnonzero((b - a).sum(axis=0) >= min(least, len(self.vectors))).max(initial=0)), -1, -1):
                    found = np.zeros(len(self.vectors), bool)
                    for t in range(self.trees):
                        found[self.order[t, a[t, length]:b[t, length]]] = True
                    if length == 0 or np.count_nonzero(found) >= least:
                        yield np.flatnonzero(found)
                        break


def search_shard(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, nearest: int, least: int) -> list[tuple[int, int, float]]:
    """``(query_id, vec_id, distance)`` of the nearest candidates of every query in one shard."""
    out = []
    for query_id, query, found in zip(query_ids, queries, Forest(vectors).candidates(queries, least)):
        found = found[ids[found] != query_id]
        distance = np.sqrt(((vectors[found] - query) ** 2).sum(axis=1))
        best: dict[int, float] = {}
        for i in np.lexsort((ids[found], distance)).tolist():
            best.setdefault(int(ids[found[i]]), float(distance[i]))
            if len(best) == nearest:
                break
        out += [(int(query_id), vec_id, d) for vec_id, d in best.items()]
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that take part, the vector in double precision, with its width."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"), F.size("embedding").alias("width"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.col("width") > 0)).where(finite)


def nearest_neighbours(vectors: DataFrame, is_query: Column, nearest: int = NEAREST, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, least: int = LEAST_CANDIDATES) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for the rows of ``vectors(vec_id, embedding)`` that ``is_query`` tells."""
    rows = settle_packed(usable(vectors), "vectors").withColumn("asks", is_query)
    sizes = {r.width: (r.n, r.q) for r in rows.groupBy("width").agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).collect()}
    count = lambda i, most: F.coalesce(F.create_map(*[F.lit(x) for w, n in sizes.items() for x in (w, -(-max(1, n[i]) // most))])[F.col("width")], F.lit(1)) if sizes else F.lit(1)
    shards, blocks = count(0, shard_rows), count(1, query_rows)
    # vec_ids are dealt by hash, so a shard's size is close to the bound and all rows of a vec_id meet
    kept = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), shards)).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    asked = (rows.where("asks").dropDuplicates(["vec_id", "v"]).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), blocks))
             .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), shards - 1))))

    def run(shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(shard) and len(block):
            shard, block = shard.sort_values("vec_id", kind="stable"), block.sort_values("vec_id", kind="stable")
            found = search_shard(shard["vec_id"].to_numpy(), np.stack(shard["v"].to_list()), block["vec_id"].to_numpy(), np.stack(block["v"].to_list()), nearest, least)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    keys = ["width", "shard", "block"]
    pairs = kept.select(*keys, "vec_id", "v").groupBy(*keys).cogroup(asked.select(*keys, "vec_id", "v").groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score double")
    best = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
