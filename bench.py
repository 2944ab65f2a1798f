"""Headline-query benchmark.

Runs the headline queries at $BENCH_SF_DIR (default /root/testdata/sf0.1)
on local[$BENCH_CPUS] and prints one JSON line. Each query is fully
evaluated through the ``noop`` sink (nothing is collected to the driver);
the reported time is the median of $BENCH_REPS warm runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyspark.plans.catalog import Q  # noqa: E402
from tallyspark.session import get_session  # noqa: E402

HEADLINE = [
    "breakdown_by_debt",      # pre-aggregated breakdown (R1)
    "breakdown_direct",       # breakdown through the full match
    "match_audit",            # full many-to-many match
    "orphan_debts",           # anti-join
    "quality_summary",        # one-pass quality counters
    "intra_file_pairs",       # duplicate-file detection
    "linearize_fixed",        # report linearization, one segment per file
    "linearize_split",        # report linearization, split-parallel
]


def default_driver_memory() -> str:
    """About 60 % of physical memory (local mode: the driver is the executor)."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
        return f"{max(1, int(total * 0.6 / 2**30))}g"
    except (ValueError, OSError, AttributeError):
        return "4g"


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]
    spark = get_session(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus),
                        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEM", default_driver_memory())})
    run(Q["pile_totals"](spark, sf_dir))  # warm-up: JVM, codegen, file listing
    times = {}
    for name in names:
        runs = []
        for _ in range(reps):
            t0 = time.perf_counter()
            run(Q[name](spark, sf_dir))
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus, "reps": reps}))


if __name__ == "__main__":
    main()
