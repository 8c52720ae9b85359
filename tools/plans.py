"""Summarise the physical plans of the headline jobs (exchanges, joins,
aggregates, scans with pushed filters and read schema) into PLANS.md.

usage: python tools/plans.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import JOBS  # noqa: E402
from pagemill.session import build_session  # noqa: E402

KEEP = re.compile(r"Exchange|Join|Aggregate|Scan parquet|FileScan|TakeOrdered|Generate|Window|Sort ")


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", shuffle_partitions=8, extra={"spark.driver.memory": "8g"})
    out = ["# Physical plans of the headline jobs", "",
           f"Generated by `tools/plans.py` at `{sf}` (local[8], AQE on). Only the operators that",
           "decide scale are kept: exchanges (shuffles), joins, aggregates, generators, sorts and",
           "scans (with their pushed filters and read schema). Projections are omitted.", ""]
    # the reply joins as they are planned when no side is small enough to broadcast
    large = {f"{n} (no broadcast)": JOBS[n] for n in ("url_to_article", "publish_docs")}
    for name, fn in [*JOBS.items(), *large.items()]:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1" if name in large else "10m")
        df = fn(spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        lines = [ln.rstrip() for ln in plan.split("\n") if KEEP.search(ln)]
        lines = [re.sub(r"(Location: InMemoryFileIndex\([^)]*\)\[[^\]]*\])", "", ln)[:260] for ln in lines]
        n_ex = sum(1 for ln in lines if "Exchange" in ln and "Broadcast" not in ln)
        out += [f"## {name}", "", f"shuffle exchanges: {n_ex}", "", "```", *lines, "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
