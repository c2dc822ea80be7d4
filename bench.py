"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores, BENCH_QUERIES (optional)
a comma-separated choice of registered queries or ``all``.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "pool_select", "pool_diagnostics", "entity_index", "entity_quota", "story_pair_edges", "story_components",
    "run_extended_grouping", "story_cohesion", "story_merge_groups", "page_titles", "page_text", "page_clean_text",
    "item_bind", "serve_latest", "serve_sync_views", "life_publish_members", "audit_funnel", "audit_cohort_metrics_path",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from newsflow import catalog

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.all_queries()
    chosen = os.environ.get("BENCH_QUERIES")
    names = list(queries) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    queries["pool_legacy"](spark, sf_dir).count()  # start the session's threads
    times = {}
    for name in names:
        start = time.perf_counter()
        df = queries[name](spark, sf_dir)
        # every column of every row is computed and thrown away; a count would prune most of it
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr)
    print(json.dumps({
        "metric": "headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
