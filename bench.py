"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS     executor threads (default 8)
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from logweave.plans.catalog import QUERIES

HEADLINE = [
    "p7_normalize", "l2_line_labels", "g1_entity_sessions", "g2_anchored_sessions", "g3_gap_chunk_sessions",
    "t1_session_split_random", "v1_template_vocabulary", "v3_tokens", "v4_token_vocabulary", "w1_sliding_windows",
    "f2_quantitative", "f4_tfidf", "f6_summed_embedding", "d1_next_event_model", "d1_supplier_model", "w1_supplier_windows", "w7_long_window_report", "d2_window_classifier",
    "d4_reconstruction_error", "d5_batch_scoring", "e4_percentile_flags", "e8_class_report", "a4_next_event_detection",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's threads and code paths before the clock runs.
    spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count().collect()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        # The whole result is computed; nothing is sent to the driver.
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
