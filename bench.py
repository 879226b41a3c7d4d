"""All registered queries of the library at one scale; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3, the median
counts; queries above LONG_SECONDS run twice and the second run counts, as the
first compiles; those above VERY_LONG_SECONDS run once), BENCH_QUERIES (comma list). The session is warmed by one small query before anything is timed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from metalint.plans.catalogue import QUERIES  # noqa: E402
from metalint.session import local_session  # noqa: E402

LONG_SECONDS = 3.0
VERY_LONG_SECONDS = 20.0


def once(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or sorted(QUERIES)
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), 8)
    once(spark, "reach_states", sf_dir)
    timings: dict[str, float] = {}
    for name in names:
        taken = [once(spark, name, sf_dir)]
        if taken[0] > VERY_LONG_SECONDS:
            pass
        elif taken[0] > LONG_SECONDS and runs > 1:
            # Mostly class loading and code generation: one more run, and that one counts.
            taken = [once(spark, name, sf_dir)]
        else:
            taken += [once(spark, name, sf_dir) for _ in range(runs - 1)]
        timings[name] = round(statistics.median(taken), 3)
    print(json.dumps({
        "metric": "all queries, total of medians; second run where a query takes above 3 s, one run above 20 s", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
