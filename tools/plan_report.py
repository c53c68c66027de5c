"""Print the physical-plan features of headline queries (after execution, AQE final plans).

Usage: python tools/plan_report.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gapmeter.catalog import QUERIES  # noqa: E402
from gapmeter.session import build_session  # noqa: E402

HEADLINE = ["fact_build", "dedup_latest", "gap_pooled", "powertrain_mix", "mass_trend", "pushed_scan",
            "reversal_pairs", "hourly_intensity", "frequency_table", "split_stratified"]
FEATURES = ["SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin",
            "CartesianProduct", "WindowGroupLimit", "ObjectHashAggregate", "HashAggregate", "Exchange hashpartitioning",
            "Exchange SinglePartition", "AQEShuffleRead", "WholeStageCodegen", "FlatMapGroupsInPandas",
            "BatchEvalPython", "Generate"]


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    for n in HEADLINE:
        df = QUERIES[n](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        counts = {f: plan.count(f) for f in FEATURES if f in plan}
        pushed = sorted(set(re.findall(r"PushedFilters: \[([^\]]*)\]", plan)))
        parts = sorted(set(re.findall(r"PartitionFilters: \[([^\]]+)\]", plan)))
        print(f"## {n}\n- operators: {counts}")
        if any(pushed):
            print(f"- pushed filters: {[p[:120] for p in pushed if p]}")
        if parts:
            print(f"- partition filters: {[p[:120] for p in parts]}")
        print()


if __name__ == "__main__":
    main()
