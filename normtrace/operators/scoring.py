"""Scores, verdicts and synthesis of scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normtrace.functions.scores import round_score, verdict
from normtrace.operators.causal import SCENARIO


def score(decisions: DataFrame, scenarios: DataFrame | None = None) -> DataFrame:
    """Weighted share of sound occurrences per scenario, in [0, 1].

    Every occurrence counts with the weight of its state (1 when the norm does not know it, 0 for a
    sink); a total of 0 scores 1.0. With ``scenarios`` given, those without any activation are added
    with score 1.0 and ``evaluated`` false.
    """
    weighted = (
        decisions.where("activated")
        .withColumn("w", F.col("occurrences") * F.coalesce("weight", F.lit(1)))
    )
    sums = weighted.groupBy(*SCENARIO).agg(
        F.sum("w").alias("total_weight"),
        F.sum(F.when(F.col("contaminated"), F.lit(0)).otherwise(F.col("w"))).alias("compliant_weight"),
        F.lit(True).alias("evaluated"),
    )
    if scenarios is not None:
        sums = scenarios.select(*SCENARIO).join(sums, SCENARIO, "left")
    total, compliant = F.coalesce("total_weight", F.lit(0)), F.coalesce("compliant_weight", F.lit(0))
    return sums.select(
        *SCENARIO,
        total.alias("total_weight"),
        compliant.alias("compliant_weight"),
        F.when(total == 0, F.lit(1.0)).otherwise(round_score(compliant / total)).alias("score"),
        F.coalesce("evaluated", F.lit(False)).alias("evaluated"),
    )


def scenario_counts(decisions: DataFrame) -> DataFrame:
    """Score, verdict and counts per scenario, for summaries that need no lists."""
    w = F.when(F.col("activated"), F.col("occurrences") * F.coalesce("weight", F.lit(1))).otherwise(F.lit(0))
    sound = F.sum(F.when(F.col("contaminated"), F.lit(0)).otherwise(w))
    score = F.when(F.sum(w) == 0, F.lit(1.0)).otherwise(round_score(sound / F.sum(w)))
    return with_verdict(decisions.groupBy(*SCENARIO).agg(
        score.alias("score"),
        F.count_if(F.col("activated") & ~F.col("contaminated")).alias("n_validated"),
        F.count_if(F.col("activated") & F.col("contaminated")).alias("n_violations"),
        F.count_if("contaminated").alias("n_contaminated"),
    ))


def with_verdict(scores: DataFrame) -> DataFrame:
    return scores.withColumn("verdict", verdict(F.col("score")))


def average_score(scenario_results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean score over the scenarios without an error, null when there are none.

    Summed as decimals, so the mean does not depend on the order in which partitions are added.
    """
    fine = F.col("error").isNull() if "error" in scenario_results.columns else F.lit(True)
    return scenario_results.groupBy(*(by or ["norm_id"])).agg(
        F.count("*").alias("n_scenarios"),
        F.count_if(fine).alias("n_valid"),
        round_score(F.avg(F.when(fine, F.col("score").cast("decimal(20,12)")))).cast("double").alias("average_score"),
    )


def macro_gate(norms: DataFrame, flag: str = "macro_conformance") -> tuple[DataFrame, DataFrame]:
    """(rows to audit, rows to explain at once): only an explicit false stops a row."""
    stop = F.col(flag).eqNullSafe(F.lit(False))
    return norms.where(~stop), norms.where(stop)


def isolate_errors(results: DataFrame, failed: DataFrame) -> DataFrame:
    """Results with an ``error`` column; a failing scenario is a row with its error, not an exception."""
    return results.join(failed.select(*SCENARIO, "error"), SCENARIO, "left")
