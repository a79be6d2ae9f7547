"""Seconds of the headline queries, one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from loomgraph.plans import catalog

HEADLINE = (
    "hub_nodes degree_table usages_by_caller orphan_edges_anti hunk_node_interval_join nearest_definition_asof pending_resolution_tiers evidence_union_verdict "
    "cross_check_buckets bm25_search hash_embed knn_cosine explore_bfs reverse_impact_bfs modularity_by_label commit_risk trust_verdict change_session_fold"
).split()


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        each = []
        for _ in range(2):  # the first compiles
            start = time.time()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            each.append(time.time() - start)
        took[name] = round(min(each), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
