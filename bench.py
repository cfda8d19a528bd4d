"""Headline queries, warm session, median of three runs each; prints one JSON line."""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from driftlake import build_session  # noqa: E402
from driftlake.plans import catalog  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = [
    "json_flatten", "field_presence", "infer_contract", "schema_diff", "enum_detect", "dedup_5m", "correlate_first",
    "gate_check_event", "pii_scrub_text", "pii_scrub_nodes", "latency_quantiles", "load_stats", "rate_limit_sample",
    "alert_throttle", "proto_nodes",
]


def main():
    spark = build_session(
        "driftlake-bench", master=f"local[{CPUS}]",
        **{"spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load()
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        # the first run warms the code paths
        took[name] = round(statistics.median(runs[1:]), 3)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
             "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "cpus": int(CPUS)}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
