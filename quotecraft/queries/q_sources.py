"""Checked queries of the loaders: typed quotes CSV, index download, calendar
file, declared schemas, lenient-cast rejects and the arithmetic rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as SC
from ..functions.columns import int_div, real_div
from ..operators import quality as q
from ..params import W_LONG
from ..plans.study import Study
from ..session import new_table_path
from ..sources import loaders
from .registry import query

WL = W_LONG


def S(spark, d):
    return Study(spark, d)


@query("src_02_quotes_csv", "SELECT * FROM eod_quotes")
def src_02_quotes_csv(spark, d):
    src = loaders.write_csv(S(spark, d).quotes, new_table_path(spark, "eod_csv"))
    typed = loaders.read_quotes_csv(spark, src)
    path = loaders.store_by_year(typed, new_table_path(spark, "eod_quotes"))
    return spark.read.parquet(path).drop("year")


@query("src_03_index_csv", "SELECT * FROM eod_indices")
def src_03_index_csv(spark, d):
    raw = loaders.index_download_frame(S(spark, d).indices)
    path = loaders.write_csv(raw, new_table_path(spark, "sp500tr_download"))
    return loaders.read_index_csv(spark, path)


@query("src_04_calendar_csv", "SELECT * FROM custom_calendar")
def src_04_calendar_csv(spark, d):
    cal = S(spark, d).custom_calendar.select(F.date_format("date", "yyyy-MM-dd").alias("date"),
                                             "y", "m", "d", "dow", "trading")
    path = loaders.write_csv(cal, new_table_path(spark, "custom_calendar_csv"))
    return loaders.read_calendar_csv(spark, path)


@query("src_06_declared_schema", "SELECT * FROM company_list_raw")
def src_06_declared_schema(spark, d):
    return SC.conform(S(spark, d).staging.select(
        "symbol", F.col("exchange").alias("stock_mkt_name"), F.col("name").alias("company_name"),
        "market_cap", "country", "ipo_year", "sector", "industry"), SC.COMPANY_LIST)


@query("cln_03_cast_rejects", """
SELECT symbol, exchange, 'market_cap' AS column_name, market_cap AS value FROM temp_company_list
WHERE market_cap IS NOT NULL AND TRY_CAST(market_cap AS DOUBLE) IS NULL
UNION ALL
SELECT symbol, exchange, 'pct_change', pct_change FROM temp_company_list
WHERE pct_change IS NOT NULL AND TRY_CAST(pct_change AS DOUBLE) IS NULL""")
def cln_03_cast_rejects(spark, d):
    _typed, rejects = q.cast_lenient(S(spark, d).staging, {"market_cap": "double", "pct_change": "double"},
                                     ["symbol", "exchange"])
    return rejects


@query("scl_07_arithmetic", """
SELECT ticker, count(*) // 252 AS full_years, count(*) AS n,
       CAST(max(adj_close) AS FLOAT) / CAST(min(adj_close) AS FLOAT) AS high_low_ratio
FROM eod_quotes GROUP BY ticker""")
def scl_07_arithmetic(spark, d):
    g = S(spark, d).quotes.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.max("adj_close").alias("_hi"),
                                F.min("adj_close").alias("_lo"))
    return g.select("ticker", int_div(F.col("n"), 252).alias("full_years"), "n",
                    real_div(F.col("_hi"), F.col("_lo")).alias("high_low_ratio"))
