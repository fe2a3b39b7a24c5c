"""Times the headline queries: one JSON line.  BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS (warm runs, 3) can be set."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

os.environ.setdefault("PYTHONWARNINGS", "ignore")

HEADLINE = (
    "vector_topk", "bm25_topk", "hybrid_rrf", "search_enriched", "sliding_chunks", "hash_diff_summary", "deadcode", "impact_closure", "workspace_search", "debounce_sessions",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from lodestone.plans.bindings import QUERIES

    folder, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    cold, warm = {}, {}
    for name in HEADLINE:
        cold[name] = round(once(name), 3)
        warm[name] = round(median(once(name) for _ in range(runs)), 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, median of warm runs, summed", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "cold": cold, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    sys.exit(main())
