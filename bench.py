"""Benchmark: every registered query (and the flagship) at one scale.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is executed to completion through the ``noop`` sink (no result
collected to the driver) after one warm-up run of a small query.  Prints
one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    from featurescape.session import get_session
    from featurescape.plans import registry
    from featurescape.plans.flagship import flagship

    scratch = tempfile.mkdtemp(prefix="bench-", dir="/tmp")
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                        extra={"spark.driver.memory": "16g",
                               "spark.local.dir": scratch,
                               "spark.checkpoint.dir": os.path.join(scratch, "ckpt")})
    spark.sparkContext.setCheckpointDir(os.path.join(scratch, "ckpt"))

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    run(registry.q_scaled_positions(spark, sf_dir))  # warm-up (JIT, file listing)
    timings = {}
    todo = dict(registry.QUERIES)
    todo["flagship"] = flagship
    for name, fn in todo.items():
        if only and name not in only:
            continue
        t0 = time.time()
        run(fn(spark, sf_dir))
        timings[name] = round(time.time() - t0, 3)
    total = round(sum(timings.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec",
                      "queries": timings, "sf": sf, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
