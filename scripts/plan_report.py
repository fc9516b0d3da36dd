"""Run every query once and summarise its final (post-AQE) physical plan:
shuffles, join strategies, group limits, Python stages and pushed filters.
Writes a markdown table to stdout."""
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pagesift.plans.queries import QUERIES  # noqa: E402
from pagesift.session import build_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
spark = build_session("local[8]", shuffle_partitions=16)
KINDS = [("Exchange hashpartitioning", "hash shuffles"), ("Exchange rangepartitioning", "range shuffles"),
         ("Exchange RoundRobinPartitioning", "spread"), ("BroadcastHashJoin", "broadcast joins"),
         ("SortMergeJoin", "sort-merge joins"), ("HashAggregate", "hash aggs"),
         ("SortAggregate", "sort aggs"), ("WindowGroupLimit", "group limits"), ("Window ", "windows"),
         ("ArrowEvalPython", "pandas UDF"), ("MapInPandas", "mapInPandas")]
print("| query | " + " | ".join(k for _, k in KINDS) + " | pushed filters |")
print("|---|" + "---|" * (len(KINDS) + 1))
for name, fn in QUERIES.items():
    df = fn(spark, sf)
    qe = df._jdf.queryExecution()
    qe.toRdd().count()  # runs this plan, so AQE's final plan is what we read
    plan = qe.executedPlan().toString().split("== Initial Plan ==")[0]
    counts = [str(plan.count(pat)) for pat, _ in KINDS]
    pushed = sorted(set(re.findall(r"PushedFilters: \[([^\]]+)\]", plan)))
    print(f"| {name} | " + " | ".join(counts) + f" | {'; '.join(pushed)[:120]} |", flush=True)
