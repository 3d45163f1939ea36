"""Time every registered query; prints one JSON line.

BENCH_SF_DIR: folder with the parquet tables (default sf0.1)
BENCH_CPUS: local cores (default all)
BENCH_QUERIES: comma-separated names (default all)
"""

from __future__ import annotations

import json
import os
import sys
import time

from tidemark.queries import REGISTRY
from tidemark.session import local_session


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(REGISTRY)
    spark = local_session(os.environ.get("BENCH_CPUS", "*"), "tidemark-bench")
    # Start the JVM's code paths and the Python workers once, outside the timings.
    for warm in ("dollar_link", "pearson", "bootstrap_ci"):
        REGISTRY[warm].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    spark.stop()
    line = {
        "metric": "total seconds over all queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
