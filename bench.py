"""Benchmark the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (default 3; the best run of each query is reported).
Each query runs to completion through the ``noop`` sink (every row computed,
nothing collected to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from migtrack.plans import registry  # noqa: E402
from migtrack.session import get_session  # noqa: E402

HEADLINE = ("clean_script", "drop_marked", "param_list", "metadata_upsert", "latest_status",
            "attach_params", "result_upsert", "stage_dedup", "script_status", "call_build",
            "test_ids", "step_counts")


def driver_memory() -> str:
    """60 % of physical memory, at least 1 GB and at most 16 GB (local mode runs in the driver)."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (ValueError, OSError, AttributeError):
        return "4g"
    return f"{max(1, min(16, int(total * 0.6 / 2**30)))}g"


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=cpus,
                        extra={"spark.driver.memory": driver_memory(),
                               "spark.checkpoint.dir": tempfile.mkdtemp(prefix="migtrack-bench-")})
    spark.sparkContext.setLogLevel("ERROR")
    qs = registry.queries()
    # warm the JVM and the parquet footers once
    qs["routine_scan"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        best = None
        for _ in range(repeat):
            t0 = time.perf_counter()
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            el = time.perf_counter() - t0
            best = el if best is None else min(best, el)
        times[name] = round(best, 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
