"""Write PLANS.md: physical plans of the headline operators over stored base
tables (what a cluster run would execute), with exchange counts."""

import re
import sys

sys.path.insert(0, ".")
from pyspark.sql import functions as F  # noqa: E402

from quotecraft.operators import performance as pf  # noqa: E402
from quotecraft.operators import returns as rt  # noqa: E402
from quotecraft.params import W_LONG  # noqa: E402
from quotecraft.plans.portfolio_study import PortfolioStudy  # noqa: E402
from quotecraft.plans.study import Study, store_base  # noqa: E402
from quotecraft.session import get_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", 8)
    base = store_base(spark, sf)
    st = Study(spark, sf, W_LONG, base=base)
    items = [
        ("Window view of the stored quotes (pushdown, pruning)", st.v_quotes),
        ("RET-01 strict returns, window form", st.mv_ret1),
        ("JON-03 / RET-01 strict returns, the reference's self join", rt.strict_returns_join(st.mv_eod1, st.calendar)),
        ("R path: UNION -> completeness -> grid -> LOCF -> returns -> screen", st.eod_ret),
        ("RET-08 CAPM table", pf.capm_table(st.eod_ret, st.eod_ret.where(F.col("symbol") == "SP500TR"))),
        ("PTF-04 min-variance weights, 200 sampled portfolios",
         PortfolioStudy.sampled(spark, sf, W_LONG, 200, 8, base=base).weights),
    ]
    out = ["# Physical plans of the headline operators", "",
           "Generated by `scripts/plans_md.py` over base tables stored with `store_base` (sf0.01).",
           "Counts are of the main plan (subqueries excluded).", ""]
    for title, df in items:
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        main_plan = plan.split("\n+- == Initial Plan ==")[0]
        main_only = "\n".join(l for l in main_plan.split("\n") if "Subquery" not in l)
        ex = len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition)", main_only))
        bc = len(re.findall(r"BroadcastExchange", main_only))
        out += [f"## {title}", "", f"shuffle exchanges: {ex}, broadcast exchanges: {bc}", "", "```",
                main_plan.strip()[:6000], "```", ""]
    open("PLANS.md", "w").write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
