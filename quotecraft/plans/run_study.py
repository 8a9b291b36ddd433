"""Run the whole study and write every output table -- the two scripts end to end.

    python -m quotecraft.plans.run_study --sf-dir /root/testdata/sf0.01 --out <shared folder>/study
    python -m quotecraft.plans.run_study --quotes q.csv --index idx.csv --companies nasdaq.csv:NASDAQ \\
        --companies nyse.csv:NYSE --companies amex.csv:AMEX --holidays hol.parquet \\
        --start 2015-12-31 --end 2021-03-26 --out <shared folder>/study

Outputs (parquet unless noted), in dependency order:
company_list, exclusions, mv_eod, mv_ret, export_daily_prices (csv),
export_monthly_prices (csv), export_daily_returns (csv), eod_ret, eod_ret_wide
(csv, the listed tickers), stats, distributions, annualized, capm, cumulative,
drawdown, boxplot, weights, portfolio_returns, portfolio_annualized.

The stored views are refreshed in order (exclusions -> prices -> returns),
and eod_ret is written before the analyses read it, as the scripts do.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calendar as cal_ops
from ..operators import performance as pf
from ..operators import portfolio as pt
from ..operators.prices import pivot_wide, wide_blocks
from ..params import BENCHMARK, COMPLETENESS, REF_INNER, SCALE_DAILY, StudyWindow
from ..sources import exports, loaders
from ..sources.refresh import refreshed_study_views
from .portfolio_study import PortfolioStudy
from .study import Study


def _parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def run(study: Study, out: str, tickers: list[str] | None = None, scale: int = SCALE_DAILY) -> dict[str, str]:
    """Write the study's outputs under ``out``; returns name -> path.

    The base tables are stored first (read many times below), and eod_ret is
    stored before the analyses.
    """
    study = study.with_stored_base()
    spark, w = study.spark, study.w
    paths: dict[str, str] = {}

    def put(name: str, df: DataFrame, csv: bool = False) -> None:
        path = f"{out.rstrip('/')}/{name}"
        (loaders.write_csv(df, path) if csv else _parquet(df, path))
        paths[name] = path

    put("company_list", study.company_list)
    views = refreshed_study_views(study)
    put("exclusions", views["exclusions"])
    put("mv_eod", views["mv_eod"])
    put("mv_ret", views["mv_ret"])
    cal = study.calendar
    put("export_daily_prices", exports.calendar_export(cal, views["mv_eod"], w, keep_date=True), csv=True)
    put("export_monthly_prices", exports.calendar_export(cal, views["mv_eod"], w, eom_only=True, keep_date=True),
        csv=True)
    put("export_daily_returns", exports.calendar_export(cal, views["mv_ret"], w, keep_date=True), csv=True)

    eod_ret = study.eod_ret_stored                     # written once, read by every analysis
    put("eod_ret", eod_ret)
    # wide CSV as the script writes it: every kept series a column, in further
    # tables (eod_ret_wide_2, ...) above WIDE_BLOCK columns
    blocks = [pivot_wide(eod_ret, tickers, "ret")] if tickers else wide_blocks(eod_ret, "ret")
    for k, wide in enumerate(blocks, 1):
        put("eod_ret_wide" if k == 1 else f"eod_ret_wide_{k}", wide, csv=True)
    ra = eod_ret if tickers is None else eod_ret.where(F.col("symbol").isin(tickers))
    rb = eod_ret.where(F.col("symbol") == BENCHMARK)
    put("stats", pf.stats_table(ra, places=None))
    put("distributions", pf.distributions_table(ra, places=None))
    put("annualized", pf.annualized_table(ra, scale, places=None))
    put("capm", pf.with_correlation_p_value(pf.capm_table(ra, rb, scale, places=None)))
    put("cumulative", pf.cumulative_series(ra, places=None))
    put("drawdown", pf.drawdown_series(ra, places=None))
    put("boxplot", pf.boxplot_stats(ra, places=None))

    if tickers:
        ps = PortfolioStudy(study, lambda st: pt.fixed_universe(spark, tickers))   # reuses the stored grid
        put("weights", ps.weights)
        put("portfolio_returns", ps.portfolio_returns)
        put("portfolio_annualized", pf.annualized_table(ps.rp, scale, key=["portfolio_id", "series"], places=None))
    return paths


def _base_from_files(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    staging = None
    for spec in a.companies:
        path, market = spec.rsplit(":", 1)
        df = loaders.read_company_file(spark, path, market)
        staging = df if staging is None else staging.unionByName(df)
    hol = spark.read.parquet(a.holidays) if a.holidays else None
    return {"quotes": loaders.read_quotes_csv(spark, a.quotes), "indices": loaders.read_index_csv(spark, a.index),
            "staging": staging,
            "custom_calendar": cal_ops.trading_calendar(spark, a.start, a.end, holiday_dates=hol)}


def main(argv: list[str] | None = None) -> None:
    from ..session import get_session
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    p.add_argument("--sf-dir")
    p.add_argument("--quotes")
    p.add_argument("--index")
    p.add_argument("--companies", action="append", default=[], help="path:MARKET, once per market")
    p.add_argument("--holidays")
    p.add_argument("--start", default="2015-12-31")
    p.add_argument("--end", default="2021-03-26")
    p.add_argument("--threshold", type=float, default=COMPLETENESS)
    p.add_argument("--tickers", default="", help="comma-separated assets of the analyses and portfolio")
    p.add_argument("--out", required=True)
    a = p.parse_args(argv)
    spark = get_session()
    w = StudyWindow(a.start, a.end, REF_INNER, a.threshold, "run")
    base = None if a.sf_dir else _base_from_files(spark, a)
    study = Study(spark, a.sf_dir, w, base=base)
    tickers = [t for t in a.tickers.split(",") if t] or None
    for name, path in run(study, a.out, tickers).items():
        print(f"{name}\t{path}")


if __name__ == "__main__":
    main()
