"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Every query
runs from the source tables to a no-op sink; nothing is cached between queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tellerlake.registry import QUERIES  # noqa: E402
from tellerlake.session import local_session  # noqa: E402

HEADLINE = [
    "run_pipeline", "build_fact_payment", "build_fact_balance", "member_payment_summary", "member_health_trends",
    "product_recommendation_metrics", "payments_by_region", "payment_gaps", "last_12_payments", "top_members_by_payments",
    "range_similar_customers", "scd2_reload_changed", "member_features", "rule_recommend", "dw_features", "robust_scale",
    "cosine_knn", "approx_knn", "kmeans_segments", "pca_components", "ml_recommend", "vector_top_k", "embedding_knn",
    "query_log_counter_stream", "destructive_guard", "section_split", "orphan_keys",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.read.parquet(f"{folder}/region.parquet").count()
    times = {}
    for key in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
        print(f"{key}: {times[key]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
