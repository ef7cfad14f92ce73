"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from gneiss.plans import catalogue

HEADLINE = (
    "re_count", "lines_scan", "near_lines", "seq_lines", "or_lines", "context_lines", "rank_document_topk", "word_freq_min_docs",
    "quote_verify_exact", "trace_overlap", "consistency_items", "derive_holds", "dependents_closure", "graph_depth",
    "stats_grouping_sets", "holo_divergent", "diff_scenarios", "compiled_expression", "hash_chain", "merkle_root", "manifest_diff",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.queries()
    queries["re_count"](spark, sf_dir).count()  # starts the session and reads the footers
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
