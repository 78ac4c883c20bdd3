"""Headline queries on one node: prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose data and cores.
Each time is the median of three warm runs that compute every output column.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import functions as F

from sieveline.plans import catalog
from sieveline.plans.registry import table
from sieveline.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "clean_text", "step_counters", "tier1_inspect", "triage_cascade", "decision_distribution", "threshold_sweep",
    "tfidf_word", "tfidf_char", "lexicon_term_hits", "stratified_folds", "integrity_check", "hybrid_fallback",
]
RUNS = 3


def timed(spark, name: str) -> float:
    started = time.perf_counter()
    catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    spark = local_session("bench", cores=CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    size = table(spark, SF_DIR, "documents").agg(
        F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")
    ).first()
    seconds = {}
    for name in HEADLINE:
        timed(spark, name)  # warm-up
        seconds[name] = round(statistics.median(timed(spark, name) for _ in range(RUNS)), 3)
    rates = {
        name: {"rows_per_s": round(size["rows"] / seconds[name]), "mb_per_s": round(size["bytes"] / 1e6 / seconds[name], 1)}
        for name in ("clean_text", "step_counters", "tier1_inspect", "triage_cascade", "tfidf_word", "tfidf_char")
    }
    print(json.dumps({
        "metric": "headline queries, sum of medians", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "throughput": rates,
        "baseline": {"clean_rows_per_s": 5321, "clean_mb_per_s": 2.1},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
