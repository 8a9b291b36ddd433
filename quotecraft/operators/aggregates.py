"""Aggregations: AGG-01..03, AGG-05..07, AGG-10..12, AGG-14, AGG-16, AGG-18/19,
plus the calendar joins the monthly statistics use (JON-02, PRJ-04).

Every grouped aggregation here is decomposable (count, min, max, sum,
avg, stddev): Spark plans a partial aggregate before the shuffle, so a hot
key costs one partial row per partition, not its whole row set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import DAYS_PER_YEAR


def row_count(df: DataFrame) -> DataFrame:
    """AGG-01: ``COUNT(*)`` as a one-row frame (n bigint)."""
    return df.agg(F.count(F.lit(1)).alias("n"))


def min_max(df: DataFrame, column: str) -> DataFrame:
    """AGG-02: (min_<c>, max_<c>)."""
    return df.agg(F.min(column).alias(f"min_{column}"), F.max(column).alias(f"max_{column}"))


def summary(df: DataFrame, column: str) -> DataFrame:
    """AGG-02: (min_<c>, avg_<c>, max_<c>)."""
    return df.agg(F.min(column).alias(f"min_{column}"), F.avg(column).alias(f"avg_{column}"),
                  F.max(column).alias(f"max_{column}"))


def per_year_full_count(df: DataFrame, date_col: str = "date", per_year: int = DAYS_PER_YEAR) -> DataFrame:
    """AGG-03: (year, full_years) = rows per calendar year DIV 252 (integer division)."""
    return (df.groupBy(F.year(date_col).cast("int").alias("year"))
            .agg(F.expr(f"count(1) div {per_year}").alias("full_years")))


def count_distinct_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """AGG-05: ``COUNT(*) FROM (SELECT DISTINCT ...)`` -- a NULL counts as one value."""
    return df.select(*columns).distinct().agg(F.count(F.lit(1)).alias("n"))


def price_counts(view: DataFrame, key: str = "ticker") -> DataFrame:
    """AGG-12: (ticker, min_date, max_date, price_count)."""
    return view.groupBy(key).agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"),
                                 F.count(F.lit(1)).alias("price_count"))


def distinct_dates(df: DataFrame, key: str = "ticker") -> DataFrame:
    """AGG-10: (ticker, date_count) = COUNT(DISTINCT date)."""
    return df.groupBy(key).agg(F.countDistinct("date").alias("date_count"))


def price_stats(df: DataFrame, key: str = "ticker", value: str = "adj_close") -> DataFrame:
    """AGG-11: min / avg / max of a price per key."""
    return df.groupBy(key).agg(F.min(value).alias(f"min_{value}"), F.avg(value).alias(f"avg_{value}"),
                               F.max(value).alias(f"max_{value}"))


def frequency(df: DataFrame, key: str = "symbol") -> DataFrame:
    """AGG-16: R's ``table()`` -- (key, n)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def cell_mean(df: DataFrame, keys: Sequence[str] = ("date", "symbol"), value: str = "adj_close") -> DataFrame:
    """AGG-18: duplicate cells averaged, as ``dcast(fun.aggregate=mean)``."""
    return df.groupBy(*keys).agg(F.avg(value).alias("px"))


def series_mean(df: DataFrame, value: str = "ret", keys: Sequence[str] = ()) -> DataFrame:
    """AGG-19: mean of a series (NULLs ignored), per key when given."""
    return df.groupBy(*keys).agg(F.avg(value).alias(f"mean_{value}"))


def reason_like(exclusions: DataFrame, pattern: str) -> DataFrame:
    """CLN-07: exclusions whose reason matches a LIKE pattern."""
    return exclusions.where(F.col("reason").like(pattern))


def join_calendar(prices: DataFrame, cal: DataFrame) -> DataFrame:
    """JON-02: prices x calendar on date (calendar broadcast: one row per day)."""
    c = cal.select("date", "y", "m", "d", "dow", "trading")
    return prices.join(F.broadcast(c), "date").select(
        prices.columns[0], "date", *[x for x in prices.columns if x not in (prices.columns[0], "date")],
        "y", "m", "d", "dow", "trading")


def star_join(prices: DataFrame, cal: DataFrame) -> DataFrame:
    """PRJ-04: ``SELECT EOD.*, CC.*`` -- the calendar's ``date`` kept as ``cc_date``."""
    e, c = prices.alias("e"), F.broadcast(cal).alias("cc")
    cal_cols = [F.col("cc.date").alias("cc_date")] + [F.col(f"cc.{x}") for x in cal.columns if x != "date"]
    return e.join(c, F.col("e.date") == F.col("cc.date")).select("e.*", *cal_cols)


def monthly_price_stats(prices: DataFrame, cal: DataFrame, value: str = "adj_close",
                        places: int | None = 6) -> DataFrame:
    """AGG-14: per (symbol, y, m): min, avg, max and sample stdev of a price.

    ``places`` rounds the average and stdev (``round(x, k) + 0.0``) so two
    engines' summation orders agree; ``None`` keeps full precision.
    """
    key = prices.columns[0]
    j = join_calendar(prices, cal)
    out = j.groupBy(F.col(key).alias("symbol"), "y", "m").agg(
        F.min(value).alias(f"min_{value}"), F.avg(value).alias(f"avg_{value}"),
        F.max(value).alias(f"max_{value}"), F.stddev_samp(value).alias(f"std_{value}"))
    if places is not None:
        for c in (f"avg_{value}", f"std_{value}"):
            out = out.withColumn(c, F.round(F.col(c), places) + F.lit(0.0))
    return out


def groups_having_at_least(df: DataFrame, keys: Sequence[str], n: int, out: str = "n") -> DataFrame:
    """FLT-07: ``GROUP BY keys HAVING count(*) >= n`` (NULL group kept)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out)).where(F.col(out) >= n)


def sector_summary(companies: DataFrame, market: str) -> DataFrame:
    """AGG-06: per sector of one market: tickers and min / avg / max market cap in
    millions, ``ROUND(x::numeric, 2)`` -- rounded as a decimal, half away from zero."""
    from ..functions.columns import round_numeric
    cap = F.col("market_cap") / 1000000
    return (companies.where(F.col("stock_mkt_name") == market).groupBy("sector")
            .agg(F.count(F.lit(1)).alias("tickers"),
                 round_numeric(F.min(cap), 2).alias("min_cap_millions"),
                 round_numeric(F.avg(cap), 2).alias("avg_cap_millions"),
                 round_numeric(F.max(cap), 2).alias("max_cap_millions")))
