"""Declared schemas of the study's tables (SRC-06).

Types follow the reference's DDL: ``real`` -> FloatType, ``numeric`` ->
DecimalType(38,6), ``smallint`` -> ShortType, ``varchar(n)`` -> StringType with
the length checked by DQ-04.  ``nullable=False`` marks NOT NULL columns; the
check jobs in ``operators.quality`` enforce them on files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STAGING_COMPANY = T.StructType([T.StructField(c, T.StringType(), True) for c in (
    "symbol", "exchange", "name", "last_sale", "net_change", "pct_change", "market_cap", "country",
    "ipo_year", "volume", "sector", "industry")])

# one downloaded company file: the same columns without the market
COMPANY_FILE = T.StructType([f for f in STAGING_COMPANY.fields if f.name != "exchange"])

STOCK_MKT = T.StructType([T.StructField("stock_mkt_name", T.StringType(), False)])

COMPANY_LIST = T.StructType([
    T.StructField("symbol", T.StringType(), False),
    T.StructField("stock_mkt_name", T.StringType(), False),
    T.StructField("company_name", T.StringType(), True),
    T.StructField("market_cap", T.DoubleType(), True),
    T.StructField("country", T.StringType(), True),
    T.StructField("ipo_year", T.IntegerType(), True),
    T.StructField("sector", T.StringType(), True),
    T.StructField("industry", T.StringType(), True),
])

EOD_QUOTES = T.StructType([
    T.StructField("ticker", T.StringType(), False),
    T.StructField("date", T.DateType(), False),
    T.StructField("adj_open", T.FloatType(), True),
    T.StructField("adj_high", T.FloatType(), True),
    T.StructField("adj_low", T.FloatType(), True),
    T.StructField("adj_close", T.FloatType(), True),
    T.StructField("adj_volume", T.DecimalType(38, 6), True),
])

EOD_INDICES = T.StructType([
    T.StructField("symbol", T.StringType(), False),
    T.StructField("date", T.DateType(), False),
    T.StructField("open", T.FloatType(), True),
    T.StructField("high", T.FloatType(), True),
    T.StructField("low", T.FloatType(), True),
    T.StructField("close", T.FloatType(), True),
    T.StructField("adj_close", T.FloatType(), True),
    T.StructField("volume", T.DoubleType(), True),
])

INDEX_DOWNLOAD = T.StructType([T.StructField(c, T.StringType(), True) for c in (
    "Date", "Open", "High", "Low", "Close", "Adj Close", "Volume")])

CALENDAR = T.StructType([
    T.StructField("date", T.DateType(), False),
    T.StructField("y", T.IntegerType(), True),
    T.StructField("m", T.IntegerType(), True),
    T.StructField("d", T.IntegerType(), True),
    T.StructField("dow", T.StringType(), True),
    T.StructField("trading", T.ShortType(), True),
])

EXCLUSIONS = T.StructType([
    T.StructField("ticker", T.StringType(), False),
    T.StructField("reason", T.StringType(), True),
])

# varchar limits of the DDL, checked by DQ-04
LENGTH_LIMITS = {
    "company_list": {"symbol": 16, "stock_mkt_name": 16, "company_name": 255, "country": 255,
                     "sector": 255, "industry": 255},
    "staging": {c: 255 for c in ("symbol", "name", "last_sale", "net_change", "pct_change",
                                 "market_cap", "country", "ipo_year", "volume", "sector", "industry")},
    "eod_quotes": {"ticker": 16},
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """SRC-06: select the declared columns in order, cast to the declared types.

    Nullability is not asserted here (a lazy frame cannot know); run
    ``quality.not_null_violations`` for the NOT NULL columns.
    """
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def not_null_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if not f.nullable]
