"""Column-level helpers: the scalar functions of the study (SCL-01..09).

All are compositions of built-in expressions, so they stay inside
whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def real_div(a: Column, b: Column) -> Column:
    """SCL-07: ``real / real`` -- the quotient rounded to 4-byte float.

    Spark divides in double; rounding that once to float gives the correctly
    rounded float32 quotient, which is what a float32 division returns.
    """
    return (a.cast("float") / b.cast("float")).cast("float")


def int_div(a: Column, b: int | Column) -> Column:
    """SCL-07: integer division truncating toward zero, as ``bigint / int`` in
    PostgreSQL (Spark's ``div``)."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b).cast("bigint")


def round_numeric(x: Column, places: int) -> Column:
    """SCL-06: ``ROUND(x::numeric, k)`` -- half away from zero on the decimal
    value, returned as double."""
    return F.round(x.cast("decimal(38,10)"), places).cast("double")


def date_parts(df: DataFrame, date_col: str = "date") -> DataFrame:
    """SCL-04: ``date_part('year'|'month'|'day', date)`` as y, m, d (int)."""
    return df.select("*", F.year(date_col).cast("int").alias("y"), F.month(date_col).cast("int").alias("m"),
                     F.dayofmonth(date_col).cast("int").alias("d"))


def day_of_week(date: Column) -> Column:
    """SCL-08: three-letter day name (Mon, Tue, ...)."""
    return F.date_format(date, "EEE")


def cap_class(market_cap: Column, small_below: float = 2e9) -> Column:
    """SCL-03: a three-way CASE on market cap."""
    return (F.when(market_cap.isNull(), F.lit("unknown"))
            .when(market_cap < small_below, F.lit("small")).otherwise(F.lit("large")))


def date_index(date_text: Column) -> Column:
    """SCL-09: text row names back to a date index."""
    return F.to_date(date_text, "yyyy-MM-dd")


def nan_to_null(x: Column) -> Column:
    """R's NaN and SQL NULL are one missing value here."""
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)
