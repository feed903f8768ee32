"""Plan audit: operators that would not survive a large cluster, per registered query."""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

BAD = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "FlatMapGroupsInPandas"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def findings(df) -> dict[str, int]:
    p = plan_of(df)
    out = {b: p.count(b) for b in BAD if b in p}
    single = len(re.findall(r"Exchange SinglePartition", p))
    if single:
        out["SinglePartition"] = single
    out["shuffles"] = len(re.findall(r"Exchange hashpartitioning", p))
    return out


if __name__ == "__main__":
    from gaugeframe.plans import QUERIES
    from gaugeframe.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    for n, q in QUERIES.items():
        f = findings(q(spark, sf))
        if any(k != "shuffles" for k in f) or f["shuffles"] > 4:
            print(f"{n:34s} {f}")
