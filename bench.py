"""Headline queries: one warm-up at the smallest scale, then the median of runs into a noop sink."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from seepline.session import local_session  # noqa: E402
from workload import catalog  # noqa: E402

HEADLINE = (
    "summarize_findings",
    "explode_lines",
    "tokenize_identifiers",
    "extract_calls",
    "assign_scope",
    "context_window",
    "nearest_assignment",
    "propagate_taint",
    "file_level_taint",
    "interprocedural_fixpoint",
    "pack_python_command_injection",
    "pack_php_sql_injection",
    "pack_javascript_sql_injection",
    "pack_webconfig_auth_bypass",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cores, "seepline-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = catalog.load()
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        for name in HEADLINE:
            queries[name](spark, small).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        took = []
        for _ in range(runs):
            start = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.time() - start)
        times[name] = round(statistics.median(took), 3)
    print(json.dumps({
        "metric": "headline query seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
