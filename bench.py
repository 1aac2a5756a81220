"""Headline queries at one scale factor; prints one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_REPEAT (default 1; the median is reported when > 1).
A short warm-up on the sf0.001 tables runs first (JVM start, code generation),
so the timings are of warm runs.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from colscope.plans import registry  # noqa: E402
from colscope.session import build_session  # noqa: E402

HEADLINE = [
    "profile_details",          # full profile of lineitem: 4 passes, every column
    "profile_variables",        # variable table only
    "corr_pairwise_pearson",    # 11 columns, 66 pairs
    "corr_spearman",            # distributed average ranks
    "corr_kendall",             # exact tau-b, bit-level discordance
    "corr_strong_pairs",
    "pivot_sum",
    "pivot_median",
    "pivot_two_column_keys",
    "class_balance",
    "semantic_types",
    "top5_counts",
    "page_rows_deep",
    "histogram_left_closed",
]
WARMUP_DIR = "/root/testdata/sf0.001"


def run(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    registry.QUERIES[name](spark, sf_dir).collect()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "1")))
    spark = build_session(f"local[{cpus}]", partitions=int(cpus))
    if os.path.isdir(WARMUP_DIR):
        for name in HEADLINE:
            run(spark, name, WARMUP_DIR)
    times = {}
    for name in HEADLINE:
        times[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(repeat)), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
