"""The norm side, built once for all scenarios: states, edges, weights, reach, links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normtrace.functions.states import DEFAULT_RANK
from normtrace.operators import graph
from normtrace.operators.causal import norm_links
from normtrace.session import settle


@dataclass(frozen=True)
class Norms:
    """Tables of the norm side, all keyed by ``norm_id``."""

    states: DataFrame
    edges: DataFrame
    weights: DataFrame
    reach: DataFrame
    links: DataFrame


def build_norms(
    states: DataFrame, pre_mapped: DataFrame, entity_rank: DataFrame, default_rank: int = DEFAULT_RANK,
) -> Norms:
    """Norm side from mapped preconditions: distinct edges, forward ones only, then the closure."""
    edges = graph.forward_edges(graph.distinct_edges(pre_mapped), entity_rank, default_rank)
    return norms_from_edges(states, settle(edges, "edges"))


def norms_from_edges(states: DataFrame, edges: DataFrame) -> Norms:
    """Norm side from edges that are taken as they are (a settled or literal table).

    The links are all that the scenario side joins with, more than once; they are written to the
    shared folder, so that they are computed once and joined with their true size known.
    """
    reach = graph.reachability(edges, settled=True)
    weights = graph.out_degree_weights(states, edges)
    return Norms(states, edges, weights, reach, settle(norm_links(edges, reach, weights), "links"))


def norm_summary(states: DataFrame, edges: DataFrame, intents: DataFrame | None = None) -> DataFrame:
    """Per norm: intent of the text, number of states, number of edges."""
    counted = (
        states.select("norm_id", F.lit(1).alias("s"), F.lit(0).alias("e"))
        .unionByName(edges.select("norm_id", F.lit(0).alias("s"), F.lit(1).alias("e")))
        .groupBy("norm_id").agg(F.sum("s").alias("nb_states"), F.sum("e").alias("nb_edges"))
    )
    if intents is None:
        return counted.withColumn("intent_T", F.lit(None).cast("string"))
    return counted.join(intents.select("norm_id", "intent_T"), "norm_id", "left")
