"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf"}.
Each query is run to completion with a no-op sink (every row is produced,
nothing is collected to the driver); the value is the sum of query times.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from quotecraft.operators import aggregates as agg  # noqa: E402
from quotecraft.operators import performance as pf  # noqa: E402
from quotecraft.operators import relational as rel  # noqa: E402
from quotecraft.operators import returns as rt  # noqa: E402
from quotecraft.params import W_LONG, W_SHORT  # noqa: E402
from quotecraft.plans.portfolio_study import PortfolioStudy  # noqa: E402
from quotecraft.plans.study import Study, store_base  # noqa: E402
from quotecraft.queries import queries  # noqa: E402
from quotecraft.session import get_session  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    q = queries()
    base: dict = {}

    def S(w=W_SHORT):
        return Study(spark, sf_dir, w, base=base)

    def load(s, d):
        base.update(store_base(s, d))
        return base["quotes"]

    plan = {
        # derive + store the base tables once (quotes, indices, calendar, companies)
        "load_base_tables": load,
        "all_tickers_union": lambda s, d: rel.all_keys_union(S().v_company_list, S().quotes, "symbol", "ticker"),
        "all_tickers_full_outer": lambda s, d: rel.all_keys_full_outer(S().v_company_list, S().quotes,
                                                                       "symbol", "ticker"),
        "strict_returns_window": lambda s, d: S(W_LONG).mv_ret1,
        "strict_returns_self_join": lambda s, d: rt.strict_returns_join(S(W_LONG).mv_eod1, S(W_LONG).calendar),
        "locf_grid_long": lambda s, d: S(W_LONG).locf,
        "grid_returns_screened_long": lambda s, d: S(W_LONG).eod_ret,
        "stats_table_long": lambda s, d: pf.stats_table(S(W_LONG).eod_ret),
        "capm_table_long": lambda s, d: pf.capm_table(S(W_LONG).eod_ret,
                                                      S(W_LONG).eod_ret.where(F.col("symbol") == "SP500TR")),
        "monthly_index_stats": lambda s, d: agg.monthly_price_stats(S(W_LONG).v_indices, S(W_LONG).custom_calendar),
        "min_variance_1000_portfolios": lambda s, d: PortfolioStudy.sampled(
            s, d, W_LONG, n_portfolios=1000, n_assets=12, base=base).weights,
        # a registered query end to end from the raw driver tables: no query before it has read them for it
        "registered_refresh_from_raw": q["src_14_refresh_returns"],
    }

    # warm-up: JVM, codegen, a Python worker; derives nothing that is timed below
    warm = spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))
    run(warm.mapInArrow(lambda batches: batches, warm.schema))
    times = {}
    for name, fn in plan.items():
        t0 = time.perf_counter()
        run(fn(spark, sf_dir))
        times[name] = round(time.perf_counter() - t0, 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(sf.group(1)) if sf else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
