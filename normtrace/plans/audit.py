"""The scenario side and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normtrace.functions.scores import round_score, verdict, violation_text
from normtrace.operators.causal import SCENARIO, decide, first_activations, with_missing
from normtrace.operators.scoring import average_score
from normtrace.plans.normative import Norms
from normtrace.session import settle
from normtrace.sources.traces import number_steps

VIOLATION = "struct<transition_index:int,attempted_state:string,missing_preconditions:array<string>>"


def audit(norms: Norms, activations: DataFrame) -> DataFrame:
    """Decisions for every scenario of every norm."""
    return decide(first_activations(activations), norms.links)


def scenario_results(decisions: DataFrame, links: DataFrame, scenarios: DataFrame | None = None) -> DataFrame:
    """One row per scenario: score, verdict, violations in order of detection, contaminated states.

    All of it is one aggregation of the decisions, which hold at most the states of the norm per
    scenario and are already partitioned by scenario.
    """
    violated = F.col("activated") & F.col("contaminated")
    w = F.when(F.col("activated"), F.col("occurrences") * F.coalesce("weight", F.lit(1))).otherwise(F.lit(0))
    entry = F.struct("first_step", "first_pos", "state_id", "missing")
    summed = with_missing(decisions, links).groupBy(*SCENARIO).agg(
        F.sum(w).alias("_total"),
        F.sum(F.when(F.col("contaminated"), F.lit(0)).otherwise(w)).alias("_sound"),
        F.sort_array(F.collect_list(F.when(violated, entry))).alias("_violations"),
        F.sort_array(F.collect_list(F.when(F.col("contaminated"), F.col("state_id")))).alias("_contaminated"),
        F.count_if(F.col("activated") & ~F.col("contaminated")).alias("_validated"),
        F.lit(True).alias("_evaluated"),
    )
    if scenarios is not None:
        summed = scenarios.join(summed, SCENARIO, "left")
    extra = [c for c in (scenarios.columns if scenarios is not None else []) if c not in SCENARIO]
    total, sound = F.coalesce("_total", F.lit(0)), F.coalesce("_sound", F.lit(0))
    as_violation: Column = F.transform("_violations", lambda v: F.struct(
        v["first_step"].alias("transition_index"), v["state_id"].alias("attempted_state"),
        v["missing"].alias("missing_preconditions")))
    score = F.when(total == 0, F.lit(1.0)).otherwise(round_score(sound / total))
    return summed.select(
        *SCENARIO, *extra,
        score.alias("score"),
        verdict(score).alias("verdict"),
        F.coalesce("_evaluated", F.lit(False)).alias("evaluated"),
        F.coalesce("_validated", F.lit(0)).alias("n_validated"),
        F.coalesce(as_violation, F.array().cast(f"array<{VIOLATION}>")).alias("violations"),
        F.coalesce("_contaminated", F.array().cast("array<string>")).alias("contaminated_states"),
    )


def with_violation_text(results: DataFrame) -> DataFrame:
    return results.withColumn("violations_text", violation_text(F.col("violations")))


def audit_report(results: DataFrame, norms: DataFrame) -> DataFrame:
    """One row per scenario with the header of its norm (:func:`norm_summary`) and the norm's mean score.

    The means are one small row per norm, joined back by key; ``results`` is used twice, so it should be
    a settled table.
    """
    means = average_score(results).select("norm_id", "average_score")
    header = settle(norms.join(means, "norm_id", "left"), "header")
    return results.join(header, "norm_id", "left")


def report_documents(
    results: DataFrame, norms: DataFrame, execution_time_seconds: float | None = None, nested: bool = False,
) -> DataFrame:
    """Report objects, ready for the JSON writer: one per scenario, each with the header of its norm.

    ``nested`` makes one object per norm with all its scenarios in order instead, which then have to
    fit in a row. ``results`` needs ``scenario_pos`` and may carry ``scenario``, ``intent_F`` and
    ``explanation``.
    """
    def col(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in results.columns else F.lit(None).cast(kind)

    entry = F.struct(
        F.col("scenario_pos"),
        (col("scenario") if "scenario" in results.columns else F.col("scenario_id").cast("string")).alias("scenario"),
        F.col("score"), col("intent_F").alias("intent_F"), F.col("violations"), F.col("contaminated_states"),
        F.coalesce(col("explanation"), F.lit("")).alias("explanation"),
    )
    if nested:
        documents = results.groupBy("norm_id").agg(F.sort_array(F.collect_list(entry)).alias("_scenarios"))
    else:
        documents = results.select("norm_id", F.array(entry).alias("_scenarios"))
    means = average_score(results).select("norm_id", "average_score")
    return (
        documents.join(norms, "norm_id", "left").join(means, "norm_id", "left")
        .select(
            "norm_id",
            F.lit(execution_time_seconds).cast("double").alias("execution_time_seconds"),
            "average_score",
            F.struct("intent_T", "nb_states", "nb_edges").alias("normative_reference"),
            F.transform("_scenarios", lambda s: s.dropFields("scenario_pos")).alias("scenarios"),
        )
    )


def number_scenarios(scenarios: DataFrame, order_by: str = "scenario_id") -> DataFrame:
    """Position of each scenario in its norm (1, 2, ...), for scenarios that come without one."""
    return number_steps(scenarios, ["norm_id"], [order_by], "scenario_pos").withColumn(
        "scenario_pos", F.col("scenario_pos") + 1)
