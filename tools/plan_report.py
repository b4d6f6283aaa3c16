"""Summarise the physical plans of the headline queries.

Usage: python tools/plan_report.py [sf_dir]

Per query: shuffle exchanges (with partitioning), broadcast exchanges,
partial window limits, sort-merge / broadcast joins, pushed filters and read
schemas of the Parquet scans, and any Python evaluation node.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summarize(plan: str) -> dict:
    lines = plan.splitlines()
    shuffles = [re.sub(r"#\d+L?", "", m.group(1)) for m in (re.search(r"Exchange (\w+partitioning\([^)]*\)|SinglePartition)", l) for l in lines) if m]
    return {
        "shuffles": shuffles,
        "broadcasts": sum("BroadcastExchange" in l for l in lines),
        "smj": sum("SortMergeJoin" in l for l in lines),
        "bhj": sum("BroadcastHashJoin" in l for l in lines),
        "partial_window_limit": sum("WindowGroupLimit" in l and "Partial" in l for l in lines),
        "take_ordered": sum("TakeOrderedAndProject" in l for l in lines),
        "python_eval": sum(("BatchEvalPython" in l or "ArrowEvalPython" in l) for l in lines),
        "pushed": sorted({m.group(1) for m in (re.search(r"PushedFilters: (\[.*?\])", l) for l in lines) if m and m.group(1) != "[]"}),
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from bench import HEADLINE
    from riskloom.plans.catalog import REGISTRY
    from riskloom.session import get_session

    spark = get_session("local[8]", shuffle_partitions=16, extra_conf={"spark.ui.showConsoleProgress": "false"})
    for name in HEADLINE:
        df = REGISTRY[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()  # final adaptive plan
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = summarize(plan)
        print(f"## {name}")
        print(f"- shuffles ({len(s['shuffles'])}): {', '.join(s['shuffles']) or 'none'}")
        print(f"- joins: {s['smj']} sort-merge, {s['bhj']} broadcast-hash; broadcast exchanges: {s['broadcasts']}")
        print(f"- partial WindowGroupLimit: {s['partial_window_limit']}; TakeOrderedAndProject: {s['take_ordered']}; "
              f"Python eval nodes: {s['python_eval']}")
        if s["pushed"]:
            print(f"- pushed filters: {'; '.join(s['pushed'])}")
        print()
    spark.stop()


if __name__ == "__main__":
    main()
