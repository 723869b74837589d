"""The precondition graph of each norm: ``edges(norm_id, source, target)``, source before target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from normtrace.functions.states import DEFAULT_RANK, ENTITY_RANKS, entity
from normtrace.operators import cycles
from normtrace.session import settle

EDGE = ["norm_id", "source", "target"]


def default_entity_rank(spark) -> DataFrame:
    """The rank table ``(entity, rank)`` of the account-opening process."""
    return spark.createDataFrame(list(ENTITY_RANKS.items()), "entity string, rank int")


def distinct_edges(pre_mapped: DataFrame) -> DataFrame:
    """Edges of mapped preconditions (``source`` is a precondition of ``target``), each once.

    A row without source or target is no edge.
    """
    return pre_mapped.select(*EDGE).where("source IS NOT NULL AND target IS NOT NULL").distinct()


def rank_edges(edges: DataFrame, entity_rank: DataFrame, default_rank: int = DEFAULT_RANK) -> DataFrame:
    """Add the rank of both ends and ``kept``: does the rank grow strictly along the edge?"""
    def side(end: str) -> DataFrame:
        return entity_rank.select(
            F.col("entity").alias(f"_{end}_entity"), F.col("rank").alias(f"_{end}_rank"))

    def rank(end: str) -> Column:
        return F.coalesce(F.col(f"_{end}_rank"), F.lit(default_rank))

    return (
        edges.join(side("source"), entity(F.col("source")) == F.col("_source_entity"), "left")
        .join(side("target"), entity(F.col("target")) == F.col("_target_entity"), "left")
        .select(*edges.columns, rank("source").alias("source_rank"), rank("target").alias("target_rank"))
        .withColumn("kept", F.col("source_rank") < F.col("target_rank"))
    )


def forward_edges(edges: DataFrame, entity_rank: DataFrame, default_rank: int = DEFAULT_RANK) -> DataFrame:
    """Edges that stay once edges to an equal or lower rank are gone; always acyclic."""
    return rank_edges(edges, entity_rank, default_rank).where("kept").select(*EDGE)


def back_edges(edges: DataFrame, entity_rank: DataFrame, default_rank: int = DEFAULT_RANK) -> DataFrame:
    return rank_edges(edges, entity_rank, default_rank).where("NOT kept").select(*EDGE)


def drop_edges(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Preconditions without the removed edges."""
    return edges.join(removed.select(*EDGE), EDGE, "left_anti")


def out_degree_weights(states: DataFrame, edges: DataFrame) -> DataFrame:
    """``weight`` of every vertex: each state, and each source that is no state; sinks weigh 0."""
    ends = edges.select("norm_id", F.col("source").alias("state_id"), F.lit(1).alias("w"))
    return (
        states.select("norm_id", "state_id", F.lit(0).alias("w")).unionByName(ends)
        .groupBy("norm_id", "state_id").agg(F.sum("w").cast("int").alias("weight"))
    )


def top_weights(weights: DataFrame, n: int | None = 8, then_by: str = "state_id") -> DataFrame:
    """The heaviest ``n`` states of each norm (all if None), without weight 0."""
    order = Window.partitionBy("norm_id").orderBy(F.desc("weight"), then_by)
    ranked = weights.where("weight > 0").withColumn("place", F.row_number().over(order))
    return ranked if n is None else ranked.where(F.col("place") <= n)


def edge_audit(edges: DataFrame, entity_rank: DataFrame, default_rank: int = DEFAULT_RANK) -> DataFrame:
    """Per norm: edges given, removed by rank, removed as cycles (none can be left), and final."""
    return (
        rank_edges(edges, entity_rank, default_rank).groupBy("norm_id").agg(
            F.count("*").alias("n_raw"),
            F.count_if(~F.col("kept")).alias("n_removed_rank"),
            F.lit(0).cast("long").alias("n_removed_cycle"),
            F.count_if("kept").alias("n_final"),
        )
    )


def reachability(edges: DataFrame, settled: bool = False, limit: int = cycles.LOCAL_EDGES) -> DataFrame:
    """``(norm_id, src, dst)``: every state that can be reached from ``src`` over one edge or more.

    Norms of up to ``limit`` edges are closed where their edges meet, by bit vectors; larger ones in
    rounds. ``settled`` edges are a written or literal table of distinct edges without nulls and are
    taken as they are.
    """
    small, large = cycles.split_by_size(edges if settled else settle(distinct_edges(edges), "edges"), limit)
    near = cycles.reach_of_small(small)
    return near if large is None else near.unionByName(_closed_in_rounds(settle(large, "edges")))


def _closed_in_rounds(edges: DataFrame) -> DataFrame:
    """Closure of large norms, all together.

    Round i knows all pairs up to distance 2^i, with their distances. Only pairs at exactly that
    distance are extended, by all known pairs, and each pair up to twice as far is found that way once
    per vertex in its middle: on chains and trees once. Rounds are logarithmic in the longest shortest
    path; each writes the new pairs only.
    """
    pair = ["norm_id", "src", "dst"]
    known = edges.select("norm_id", F.col("source").alias("src"), F.col("target").alias("dst"), F.lit(1).alias("far"))
    reach = farthest = 1
    while farthest == reach:
        front = known.where(F.col("far") == reach)
        onward = known.select(F.col("norm_id").alias("_norm"), F.col("src").alias("_via"), F.col("dst").alias("_end"), F.col("far").alias("_more"))
        longer = (
            front.join(onward, F.col("norm_id").eqNullSafe(F.col("_norm")) & (F.col("dst") == F.col("_via")))
            .groupBy("norm_id", "src", F.col("_end").alias("dst")).agg((F.lit(reach) + F.min("_more")).alias("far"))
        )
        same = [longer[c].eqNullSafe(known[c]) for c in pair]
        seen = Observation()
        new = longer.join(known, same[0] & same[1] & same[2], "left_anti").observe(seen, F.max("far").alias("far"))
        known = known.unionByName(settle(new, "paths"))
        reach, farthest = 2 * reach, seen.get["far"]
    return known.select(*pair)


def cyclic_core(edges: DataFrame, settled: bool = False, limit: int = cycles.LOCAL_EDGES) -> DataFrame:
    """Edges left after trimming vertices without a way in or a way out (see :func:`cycles.cyclic_core`)."""
    return cycles.cyclic_core(edges.select(*EDGE) if settled else settle(distinct_edges(edges), "edges"), limit)


def break_cycles(edges: DataFrame, entity_rank: DataFrame, default_rank: int = DEFAULT_RANK, settled: bool = False) -> DataFrame:
    """Edges with a ``removed`` flag: core edges along which (rank, name) does not grow.

    What stays is acyclic, and the choice depends on single edges only; for a cut that removes no edge
    without need, see :func:`cut_cycles`.
    """
    edges = edges.select(*EDGE) if settled else settle(distinct_edges(edges), "edges")
    core = cyclic_core(edges, settled=True).withColumn("_core", F.lit(True))
    ranked = rank_edges(edges, entity_rank, default_rank)
    grows = F.struct("source_rank", "source") < F.struct("target_rank", "target")
    return (
        ranked.join(core, EDGE, "left")
        .select(*EDGE, (F.col("_core").isNotNull() & ~grows).alias("removed"))
    )


def cut_cycles(edges: DataFrame, entity_rank: DataFrame, default_rank: int = DEFAULT_RANK, limit: int = cycles.LOCAL_EDGES) -> DataFrame:
    """Edges with a ``removed`` flag: per witness cycle the edge along which the rank falls most, if needed."""
    ranked = settle(rank_edges(distinct_edges(edges), entity_rank, default_rank), "ranked")
    return cycles.minimal_cut(ranked, limit)
