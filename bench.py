"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with the ``noop`` sink (no collect to the
driver) and timed; caches are cleared between queries.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagelift.plans.queries import QUERIES  # noqa: E402
from pagelift.session import checkpoint_dir, local_session  # noqa: E402

HEADLINE = [
    "d1_d21_extract_basic",
    "c1_c7_extract_readable",
    "p_full_pipeline",
    "q1_q7_doc_quality",
    "u1_u5_host_guard",
    "m1_m2_metadata",
    "k1_k3_markdown_blocks",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2, app="pagelift-bench")
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    names = [n for n in HEADLINE if n in QUERIES]
    if len(sys.argv) > 1:
        names = sys.argv[1:]
    times = {}
    for name in names:
        spark.catalog.clearCache()
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    spark.catalog.clearCache()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
