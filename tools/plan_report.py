"""Summarise the final (adaptive) physical plan of every registered query.

Usage: python tools/plan_report.py [sf_dir] > plans.md
For each query: shuffle exchanges and their keys, broadcast exchanges,
partial top-k limits, Python evaluation nodes and the parquet columns read.
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from svcseam.plans.registry import REGISTRY  # noqa: E402
from svcseam.session import local_session  # noqa: E402


def _keys(expr: str) -> str:
    return re.sub(r"#\d+L?", "", expr)


def summarise(plan: str) -> dict:
    shuffles = Counter(_keys(m) for m in re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", plan))
    ranges = len(re.findall(r"Exchange rangepartitioning", plan))
    return {
        "shuffles": sum(shuffles.values()) + ranges,
        "keys": "; ".join(f"{k}×{n}" if n > 1 else k for k, n in shuffles.most_common()),
        "broadcasts": plan.count("BroadcastExchange"),
        "group_limit": plan.count("WindowGroupLimit"),
        "python": plan.count("ArrowEvalPython") + plan.count("FlatMapGroupsInPandas"),
        "scans": len(re.findall(r"FileScan parquet", plan)) + len(re.findall(r"Scan ExistingRDD|Scan parquet", plan)),
    }


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    print("| query | shuffles | shuffle keys | broadcasts | partial top-k | python nodes |")
    print("| --- | --- | --- | --- | --- | --- |")
    for name, fn in sorted(REGISTRY.items()):
        df = fn(spark, sf)
        df.write.format("noop").mode("overwrite").save()
        s = summarise(df._jdf.queryExecution().executedPlan().toString())
        print(f"| `{name}` | {s['shuffles']} | {s['keys'] or '—'} | {s['broadcasts']} | {s['group_limit']} | "
              f"{s['python']} |")


if __name__ == "__main__":
    main()
