"""Market tables derived from the driver's parquet tables.

The study needs a quotes table, an index table, a company staging table and a
trading calendar; the driver ships TPC-H-like tables instead.  These
functions derive tables of the study's shapes from them with Spark's own
aggregates, so every derived table grows with the input.  The rules (which
columns become prices, which customers list on which market) are fixed test
rules, the same ones the SQL oracle writes in its CTEs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.calendar import calendar_spanning
from ..params import BENCHMARK, FIXED_HOLIDAYS


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def source_date_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row (first_date, last_date) over every date the sources carry."""
    ev = driver_table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("d"))
    li = driver_table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("d"))
    return ev.unionByName(li).agg(F.min("d").alias("first_date"), F.max("d").alias("last_date"))


def fixture_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trading calendar spanning the sources, seed row first (TS-01)."""
    return calendar_spanning(source_date_bounds(spark, sf_dir), FIXED_HOLIDAYS)


def _prices(df: DataFrame) -> DataFrame:
    return df.select(
        "ticker", "date",
        (F.lit(100) + F.col("lo")).cast("float").alias("adj_open"),
        (F.lit(100) + F.col("hi")).cast("float").alias("adj_high"),
        (F.lit(100) + F.col("lo")).cast("float").alias("adj_low"),
        (F.lit(100) + F.col("av")).cast("float").alias("adj_close"),
        F.col("vol").cast("decimal(38,6)").alias("adj_volume"),
    )


def _weekday(col: str = "date"):
    # the calendar spans every source date, so "date in the calendar's
    # weekdays" is a plain weekday test: a narrow filter, no join
    return ~F.dayofweek(col).isin(1, 7)


def fixture_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """eod_quotes(ticker, date, adj_open, adj_high, adj_low, adj_close, adj_volume).

    ``U<user>`` from events (first days of the month skipped per user),
    ``L<line>`` and one ticker per nation from lineitem.  One row per
    (ticker, date): each branch is one grouped aggregation.
    """
    ev = driver_table(spark, sf_dir, "events").select(
        F.col("ts").cast("date").alias("date"), "user_id", "value")
    users = (ev.where(F.dayofmonth("date") > F.col("user_id") % 5)
             .groupBy(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"), "date")
             .agg(F.min("value").alias("lo"), F.max("value").alias("hi"),
                  F.avg("value").alias("av"), F.count(F.lit(1)).alias("vol")))
    li = driver_table(spark, sf_dir, "lineitem").select(
        "l_linenumber", "l_suppkey", "l_extendedprice", F.col("l_shipdate").cast("date").alias("date"))

    def by(df: DataFrame, ticker) -> DataFrame:
        return (df.groupBy(ticker.alias("ticker"), "date")
                .agg((F.min("l_extendedprice") / 1000).alias("lo"),
                     (F.max("l_extendedprice") / 1000).alias("hi"),
                     (F.avg("l_extendedprice") / 1000).alias("av"),
                     F.count(F.lit(1)).alias("vol")))

    lines = by(li, F.concat(F.lit("L"), F.col("l_linenumber").cast("string")))
    supplier = driver_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = driver_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # supplier and nation are dimension tables: Spark broadcasts them from
    # their file statistics when they are small, else sort-merge joins them
    li_n = (li.join(supplier, F.col("s_suppkey") == F.col("l_suppkey"))
              .join(nation, F.col("n_nationkey") == F.col("s_nationkey")))
    nations = by(li_n, F.col("n_name"))
    allq = users.unionByName(lines).unionByName(nations)
    return _prices(allq.where(_weekday()))


def fixture_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """eod_indices_project(symbol, date, open, high, low, close, adj_close, volume)."""
    ev = (driver_table(spark, sf_dir, "events")
          .groupBy(F.col("ts").cast("date").alias("date"))
          .agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("av")))
    li = (driver_table(spark, sf_dir, "lineitem")
          .groupBy(F.col("l_shipdate").cast("date").alias("date"))
          .agg((F.min("l_extendedprice") / 1000).alias("lo"),
               (F.max("l_extendedprice") / 1000).alias("hi"),
               (F.avg("l_extendedprice") / 1000).alias("av")))
    q = ev.unionByName(li).where(_weekday())
    return q.select(
        F.lit(BENCHMARK).alias("symbol"), "date",
        (F.lit(100) + F.col("lo")).cast("float").alias("open"),
        (F.lit(100) + F.col("hi")).cast("float").alias("high"),
        (F.lit(100) + F.col("lo")).cast("float").alias("low"),
        (F.lit(100) + F.col("av")).cast("float").alias("close"),
        (F.lit(100) + F.col("av")).cast("float").alias("adj_close"),
        F.lit(0).cast("double").alias("volume"),
    )


def fixture_company_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """_temp_company_list as all strings, plus ``exchange`` (the source file).

    The reference imports one file per market into the staging table; here
    the three imports are one frame whose ``exchange`` column names the file.
    A customer lists on the market(s) its region selects; the three markets
    are a generated array, so no join is needed to fan rows out.
    """
    cust = driver_table(spark, sf_dir, "customer")
    nation = driver_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    mk = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).alias("mkt"))
                             for k, m in enumerate(("NASDAQ", "NYSE", "AMEX"))])).alias("x")
    base = (cust.join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
            .select("*", mk).select("*", "x.k", "x.mkt"))
    key = F.col("c_custkey")
    listed = ((key % 7 != 3)
              & ((F.col("n_regionkey") % 3 == F.col("k")) | (key % 30 == 0)
                 | ((key % 10 == 0) & ((F.col("n_regionkey") + 1) % 3 == F.col("k")))))
    suffix = (F.when(key % 4 == 0, " Tech Inc.").when(key % 4 == 1, " Inc.")
              .when(key % 4 == 2, " Technologies").otherwise(" Corp"))
    return base.where(listed).select(
        F.concat(F.lit("U"), key.cast("string")).alias("symbol"),
        F.col("mkt").alias("exchange"),
        F.concat(F.lit("  "), F.col("c_name"), suffix, F.lit(" ")).alias("name"),
        F.round(F.abs("c_acctbal"), 2).cast("string").alias("last_sale"),
        F.lit("0").alias("net_change"),
        F.lit("0%").alias("pct_change"),
        F.when(key % 11 == 0, F.lit("0")).when(key % 17 == 0, F.lit(None).cast("string"))
         .otherwise(F.round(F.abs("c_acctbal") * 1000000, 0).cast("bigint").cast("string"))
         .alias("market_cap"),
        F.when(key % 13 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit(" "), F.col("n_name"))).alias("country"),
        F.when(key % 5 == 0, F.lit(None).cast("string"))
         .otherwise((F.lit(1980) + key % 40).cast("string")).alias("ipo_year"),
        F.lit("0").alias("volume"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit(None).cast("string"))
         .otherwise(F.concat(F.col("c_mktsegment"), F.lit(" "))).alias("sector"),
        F.col("c_mktsegment").alias("industry"),
    )
