"""Connected components of a graph given as edges, in rounds of aggregates and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normtrace.session import settle_packed


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _lowest(pairs: DataFrame) -> DataFrame:
    """The smallest of every vertex ``a`` and its neighbours ``b``; combined on the map side."""
    return pairs.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("m"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: neighbours above (``large``) or not above a vertex move to its smallest one."""
    pairs = _both_ways(edges) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    moved = pairs.join(settle_packed(_lowest(pairs), "lowest").withColumnRenamed("v", "a"), "a")
    if large:
        out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    return out.where("a != b").distinct()


def component_roots(edges: DataFrame) -> DataFrame:
    """``(v, root)`` for every vertex of ``edges(a, b)`` but the roots, root the smallest reachable.

    Large and small star steps take turns until nothing moves; every step is written to the shared
    folder. The smallest neighbour is aggregated first and joined back as a table of its own, so a
    vertex with very many neighbours is only a skewed join, which adaptive execution splits.
    Null ends are dropped, loops and repeated edges decide nothing, no edges give no rows.
    """
    now = settle_packed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = mark(now)
    while before[0]:
        now = settle_packed(_star(settle_packed(_star(now, True), "edges"), False), "edges")
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("v"), F.col("b").alias("root"))
