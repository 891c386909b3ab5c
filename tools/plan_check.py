"""Physical-plan report per registered query: shuffle exchanges by origin,
broadcasts, and the columns each parquet scan reads (column pruning).

    python tools/plan_check.py [sf_dir] [query ...]

Queries that execute while being built (checkpointed pipeline passes, streams)
are skipped unless named.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pagelift.plans.queries import QUERIES  # noqa: E402
from pagelift.session import checkpoint_dir, local_session  # noqa: E402

EAGER = {"p_full_pipeline", "r7_rejected", "a5_approval_gate", "a7_byline", "s5_s6_sinks",
         "t1_stream_scrape", "t2_approval_join", "s4_rendered_copies", "u1_u5_host_guard", "u5_redirect_guard", "a5_approval_gate"}


def report(df) -> dict:
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    shuffles = {}
    for ln in lines:
        m = re.search(r"Exchange hashpartitioning\(([^)]*)\), (\w+)", ln)
        if m:
            shuffles[(m.group(1).split(",")[0].split("#")[0], m.group(2))] = True
    scans = sorted({re.sub(r"#\d+L?", "", m) for m in re.findall(r"FileScan parquet \[([^\]]*)\]", plan)})
    return {"shuffles": sorted(f"{k}:{o}" for k, o in shuffles),
            "broadcasts": plan.count("BroadcastExchange"), "scans": scans}


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or [n for n in sorted(QUERIES) if n not in EAGER]
    spark = local_session(cores=4, shuffle_partitions=4)
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    for name in names:
        r = report(QUERIES[name](spark, sf))
        print(f"{name}: shuffles={r['shuffles']} broadcasts={r['broadcasts']} scans={r['scans']}")
        spark.catalog.clearCache()


if __name__ == "__main__":
    main()
