"""Comparison of models over ``generations(doc_id, model, latency_s, completion_tokens, status, ...)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normtrace.operators.models import SUCCESS


def corpus_stats(generations: DataFrame) -> DataFrame:
    """One row: rows, mean latency, mean generated tokens (nulls left out)."""
    return generations.agg(
        F.count("*").alias("n_rows"),
        F.avg("latency_s").alias("mean_latency_s"),
        F.avg("completion_tokens").alias("mean_tokens"),
    )


def model_summary(generations: DataFrame, success: str = SUCCESS) -> DataFrame:
    """Per model: rows, successes, failures, rate in %, mean latency, mean tokens."""
    ok = F.count_if(F.col("status") == success)
    return generations.groupBy("model").agg(
        F.count("*").alias("n_total"),
        ok.alias("n_success"),
        (F.count("*") - ok).alias("n_failure"),
        F.bround(100.0 * ok / F.count("*"), 2).alias("success_pct"),
        F.bround(F.avg("latency_s"), 2).alias("mean_latency_s"),
        F.bround(F.avg("completion_tokens"), 1).alias("mean_tokens"),
    )


def leaderboard(summary: DataFrame) -> DataFrame:
    """Best success rate first, then lowest latency."""
    return summary.orderBy(F.desc("success_pct"), F.asc("mean_latency_s"))


def status_distribution(generations: DataFrame) -> DataFrame:
    """Share of each status per model in %, null statuses left out, largest first."""
    counts = generations.where("status IS NOT NULL").groupBy("model", "status").agg(F.count("*").alias("n"))
    totals = counts.groupBy(F.col("model").alias("_model")).agg(F.sum("n").alias("_total"))
    shares = counts.join(totals, F.col("model").eqNullSafe(F.col("_model")))
    return shares.select("model", "status", "n", F.bround(100.0 * F.col("n") / F.col("_total"), 2).alias("pct")) \
        .orderBy("model", F.desc("pct"), "status")


def success_ratio(generations: DataFrame, by: list[str], success: str = SUCCESS) -> DataFrame:
    """Share of successful rows; a null status is no success."""
    ok = F.col("status").eqNullSafe(F.lit(success))
    return generations.groupBy(*by).agg(
        F.count("*").alias("n_total"),
        F.count_if(ok).alias("n_success"),
        F.count_if(~ok).alias("n_failure"),
        F.avg(ok.cast("double")).alias("ratio"),
    )
