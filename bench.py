"""Time the registered queries and print one JSON line.

Each query is built, planned and run to its last row, twice for batch queries (the
faster run counts, as the first one also loads classes) and once for streams.
"""

from __future__ import annotations

import json
import os
import time

from rowtide.plans import CATALOG
from rowtide.session import local_session


def seconds(spark, run, sf_dir: str) -> float:
    started = time.perf_counter()
    run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(cores=int(os.environ.get("BENCH_CPUS", "8")), app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds(spark, CATALOG["pricing_summary"].run, sf_dir)
    times = {}
    for name, found in CATALOG.items():
        runs = 1 if name.startswith("stream_") else 2
        times[name] = round(min(seconds(spark, found.run, sf_dir) for _ in range(runs)), 3)
    spark.stop()
    print(json.dumps({
        "metric": "total query time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
