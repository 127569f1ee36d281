"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  folder of the tables   (default /root/testdata/sf0.1)
BENCH_CPUS    local cores            (default 8)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from broadsheet.plans.catalog import QUERIES
from broadsheet.session import build_session

HEADLINE = (
    "keyword_classify", "quality_score", "published_view", "article_page", "ordered_dedup",
    "store_upsert", "parse_classification", "classify_modes", "budget_gate", "source_run_metrics",
    "page_extract", "page_scan", "feed_entries", "stratified_sample", "class_metrics",
    "markdown_docs", "reclassify_diff", "run_state", "stream_ingest_store", "article_pipeline",
)
REPEATS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus,
           "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("article_hash")  # start the JVM's workers before the clock runs
    seconds = {n: round(statistics.median(run(n) for _ in range(REPEATS)), 3) for n in names}
    print(json.dumps({
        "metric": "sum of median seconds per query", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
