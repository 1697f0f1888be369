"""Flag plan shapes that do not scale in every registered query.

    python scripts/audit_plans.py [sf_dir]

Reports per query: scans by table, number of shuffle exchanges, and any
cartesian product, nested-loop join, window without PARTITION BY, or sort-based
aggregate.  Automatic broadcasts are off, as they would be for large inputs.
"""
import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from histofold.plans.queries import QUERIES  # noqa: E402
from histofold.session import get_spark  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
spark = get_spark("local[8]", 16)
spark.conf.set("spark.sql.adaptive.enabled", "false")  # static plan: what the optimizer chose
spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
print("| query | scans | shuffle exchanges | single-partition | hinted broadcasts | flags |")
print("| --- | --- | --- | --- | --- | --- |")
for name, fn in sorted(QUERIES.items()):
    plan = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
    flags = []
    for pat in ("CartesianProduct", "BroadcastNestedLoopJoin", "SortAggregate"):
        if pat in plan:
            flags.append(pat)
    for line in plan.splitlines():
        if "Window [" in line:
            # "Window [fns], [partition], [order]" -- two lists mean no PARTITION BY
            lists = re.findall(r"\], \[", line.split("Window [", 1)[1])
            if len(lists) < 2:
                flags.append("Window-without-partition")
    n_ex = len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition", plan))
    single = plan.count("Exchange SinglePartition")
    bcast = plan.count("BroadcastExchange")
    tables = Counter(re.findall(r"FileScan parquet (?:spark_catalog\.default\.)?(?:histofold_\w+)?.*?/([a-z_]+?)(?:\.parquet)?\]", plan))
    scans = " ".join(f"{t}×{n}" if n > 1 else t for t, n in sorted(tables.items())) or "-"
    print(f"| `{name}` | {scans} | {n_ex} | {single} | {bcast} | {' '.join(flags) or '-'} |")
