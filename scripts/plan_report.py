"""Physical-plan report: exchanges, broadcasts, nested loops and Python steps
per registered query (no data is read beyond planning)."""

import re
import sys

sys.path.insert(0, ".")
from quotecraft.queries import queries  # noqa: E402
from quotecraft.session import get_session  # noqa: E402

PATTERNS = {"shuffle": r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition",
            "broadcast": r"BroadcastExchange", "nested_loop": r"BroadcastNestedLoopJoin|CartesianProduct",
            "python": r"FlatMapGroupsInPandas|MapInPandas|ArrowEvalPython", "window": r"\bWindow\b"}


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = sys.argv[2:]
    spark = get_session("local[8]", 8)
    for name, fn in queries().items():
        if pats and not any(p in name for p in pats):
            continue
        plan = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
        counts = {k: len(re.findall(v, plan)) for k, v in PATTERNS.items()}
        flag = "  <-- nested loop" if counts["nested_loop"] else ""
        print(f"{name:40s} " + " ".join(f"{k}={v}" for k, v in counts.items()) + flag)


if __name__ == "__main__":
    main()
