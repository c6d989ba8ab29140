"""Summarise the physical plan of every registered query: exchanges, broadcasts, windows fed by
a single partition, cartesian / nested-loop joins and Python evaluation.

    python scripts/plan_lint.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tillroll.plans.registry import QUERIES  # noqa: E402
from tillroll.session import local_session  # noqa: E402

# Windows allowed on one partition: their input is bounded whatever the data size (one row per
# calendar month; the top k stores).
BOUNDED_WINDOWS = {"monthly_growth", "store_lead_ratio"}
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


def plan_text(df) -> str:
    qe = df._jdf.queryExecution()
    return qe.executedPlan().toString()


def lint(name: str, plan: str) -> list[str]:
    problems = [f for f in FORBIDDEN if f in plan]
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if re.search(r"\bWindow\b", line) and "WindowGroupLimit" not in line:
            below = "\n".join(lines[i + 1:i + 4])
            if "SinglePartition" in below and name not in BOUNDED_WINDOWS:
                problems.append("Window over SinglePartition")
    return problems


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = local_session(4)
    bad = 0
    for name, fn in QUERIES.items():
        plan = plan_text(fn(spark, sf))
        problems = lint(name, plan)
        bad += bool(problems)
        print(f"{name:32s} exchanges={plan.count('Exchange hashpartitioning') + plan.count('Exchange rangepartitioning')}"
              f" broadcasts={plan.count('BroadcastExchange')} single={plan.count('SinglePartition')}"
              f" {'PROBLEMS: ' + ', '.join(problems) if problems else ''}")
    print("queries with problems:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
