"""Physical plan audit: python tools/plans.py [folder] [--show name]. Lists joins, windows and Python steps per query."""

from __future__ import annotations

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    show = sys.argv[3:] if "--show" in sys.argv else []
    from rewardloom.catalog import QUERIES
    from rewardloom.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    # Without automatic broadcasts a plan looks as it would over large tables; explicit broadcasts remain visible.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    for name, fn in QUERIES.items():
        if show and name not in show:
            continue
        plan = fn(spark, folder)._jdf.queryExecution().executedPlan().toString()
        if show:
            print(plan)
        found = []
        for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BroadcastHashJoin", "SortMergeJoin", "SinglePartition",
                     "ArrowEvalPython", "ObjectHashAggregate", "SortAggregate", "Window ", "Generate", "TakeOrdered"):
            count = len(re.findall(word, plan))
            if count:
                found.append(f"{word.strip()} x{count}")
        exchanges = len(re.findall(r"Exchange (?!SinglePartition)", plan))
        print(f"{name}: exchanges {exchanges}; {', '.join(found)}", flush=True)


if __name__ == "__main__":
    main()
