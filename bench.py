"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local threads and
BENCH_ONLY (comma-separated) a choice of queries. Every query is run to its last row (noop sink).
Each is first run on the smallest tables beside it, so that the timed run does not compile code.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from normtrace.plans.queries import QUERIES
from normtrace.session import build_session

HEADLINE = [
    "rank_filtered_edges", "norm_reach", "cyclic_core", "causal_violations", "step_trace", "conformance_score",
    "corpus_violations", "corpus_scores", "audit_report", "report_json", "zscore_projection", "precondition_mapping",
    "parse_scenarios", "parse_fallback", "clean_json_answers", "validate_universe", "complete_rules", "embed_text",
    "generate_metrics", "retry_upsert", "broken_cycles", "whole_audit", "stream_causal", "text_corpus_scan", "model_summary", "status_distribution", "csv_round_trip",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_ONLY", ",".join(HEADLINE)).split(",")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    times = {}
    for name in names:
        run(QUERIES[name](spark, small if os.path.isdir(small) else sf_dir))
        began = time.perf_counter()
        run(QUERIES[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "warmed": True, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
