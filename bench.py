"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS (default 8) the local cores.
Each query is planned and run to completion twice from cold caches; the second run is reported, so start-up and code
generation of the first one are left out.
"""
import json
import os
import time

from highwater.plans.catalog import QUERIES
from highwater.session import build_session

HEADLINE = ["segment_risk", "a3_elevation_features", "j4_nearest_lines", "j6_count_within", "j3_fema_midpoints", "j9_pair_twins",
            "w5_sample_negatives", "j13_report_history", "m2_prepare_panel", "a15_metrics", "w9_relative_score", "f14_effective_risk",
            "f16_map_box", "a22_describe_routes", "c3_events_with_queries", "u4_diff_alerts", "a18_dashboard", "g2_cell_components"]


def main():
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "highwater-bench", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        for _ in range(2):
            spark.catalog.clearCache()
            start = time.perf_counter()
            QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(path.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
