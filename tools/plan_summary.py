"""Summarize the physical plan of every registered query into docs/PLANS.md:
scans with their read schema and pushed filters, join strategies, shuffle
exchanges and aggregates. Usage: python tools/plan_summary.py [sf_dir]"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyspark.plans.catalog import Q  # noqa: E402
from tallyspark.session import get_session  # noqa: E402

NODE = re.compile(r"^\((\d+)\) (.+)$")


def summarize(plan: str) -> dict:
    nodes = Counter()
    scans = set()
    cur = None
    for line in plan.splitlines():
        m = NODE.match(line.strip())
        if m:
            cur = m.group(2).strip()
            name = re.sub(r"\s*\(.*$", "", cur).strip()
            nodes[name.split(" ")[0] if not name.startswith("Scan") else "Scan"] += 1
            continue
        if cur and cur.startswith("Scan parquet"):
            if line.startswith("ReadSchema:"):
                scans.add(("schema", line.split(":", 1)[1].strip()))
            elif line.startswith("PushedFilters:"):
                scans.add(("filters", line.split(":", 1)[1].strip()))
    return {"nodes": nodes, "scans": scans}


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[4]", 8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the static plan, before runtime changes
    out = ["# Physical plans of the registered queries", "",
           f"Static plans (AQE off) at `{sf}`; AQE may still switch joins to broadcast at run time.",
           "Counts are per plan, including the fixture that derives each input from the tables.", ""]
    for name, fn in Q.items():
        try:
            df = fn(spark, sf)
            plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        except Exception as e:  # noqa: BLE001
            out += [f"## {name}", "", f"(plan unavailable: {type(e).__name__})", ""]
            continue
        s = summarize(plan)
        keep = ["SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin",
                "CartesianProduct", "Exchange", "HashAggregate", "ObjectHashAggregate", "SortAggregate",
                "Window", "Generate", "TakeOrderedAndProject", "Scan"]
        counts = ", ".join(f"{k} {s['nodes'][k]}" for k in keep if s["nodes"].get(k))
        out += [f"## {name}", "", counts, ""]
        for kind, val in sorted(s["scans"]):
            if kind == "filters" and val in ("[]", ""):
                continue
            out.append(f"* {kind}: `{val[:300]}`")
        out.append("")
    os.makedirs("docs", exist_ok=True)
    with open("docs/PLANS.md", "w") as fh:
        fh.write("\n".join(out) + "\n")
    print("wrote docs/PLANS.md")


if __name__ == "__main__":
    main()
