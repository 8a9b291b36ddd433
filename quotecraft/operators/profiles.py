"""Day profiles: which days a series has, as bitmaps, so that completeness needs no prices.

A profile row is (key, word, bits, more): bit d % 64 of word d div 64 is set where the key has
a row on calendar day d, and ``more`` lists the days with several rows and how many beyond
the first.  Any number of windows and thresholds (AGG-13, CLN-04, TS-08) is then counted
from one small stored table: 64 days take a long, and a window's edge is a mask.  Rows are
counted as the reference counts them, duplicates and non-trading days included.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: day 0 of every profile
ORIGIN = dt.date(1970, 1, 1)


def day_profiles(rows: DataFrame, key: str, date_col: str = "date") -> DataFrame:
    """Profiles of ``rows``; both aggregations combine before they shuffle, and a group of the second
    holds 64 days at most.  Rows without a date have no day and count nowhere."""
    day = F.unix_date(F.col(date_col))
    per_day = rows.where(F.col(date_col).isNotNull()).groupBy(key, day.alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    word, bit = F.floor(F.col("_d") / 64).cast("int"), F.pmod(F.col("_d"), F.lit(64))
    several = F.when(F.col("_n") > 1, F.struct(F.col("_d").alias("day"), (F.col("_n") - 1).alias("n")))
    return per_day.groupBy(key, word.alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"), F.collect_list(several).alias("more"))


def merge_profiles(*profiles: DataFrame, key: str) -> DataFrame:
    """One profile of series whose rows lie in several tables (a day's rows in one of them only)."""
    both = profiles[0]
    for p in profiles[1:]:
        both = both.unionByName(p)
    return both.groupBy(key, "word").agg(F.bit_or("bits").alias("bits"), F.flatten(F.collect_list("more")).alias("more"))


def _day(value: str) -> int:
    return (dt.date.fromisoformat(value) - ORIGIN).days


def rows_in(start: str, end: str) -> Column:
    """How many rows a profile row has in [start, end]."""
    a, b = _day(start), _day(end)
    # the window's first and last bit inside the word
    low = F.greatest(F.lit(a) - F.col("word") * 64, F.lit(0))
    high = F.least(F.lit(b) - F.col("word") * 64, F.lit(63))
    ones = F.lit(-1).cast("long")
    mask = F.call_function("shiftleft", ones, low).bitwiseAND(F.call_function("shiftrightunsigned", ones, F.lit(63) - high))
    more = F.aggregate(F.filter("more", lambda m: m["day"].between(a, b)), F.lit(0).cast("long"), lambda s, m: s + m["n"])
    return F.when((low <= 63) & (high >= 0), F.bit_count(F.col("bits").bitwiseAND(mask)) + more).otherwise(0)


def completeness_of(profiles: DataFrame, key: str, start: str, end: str, denominator: Column, real: bool = True) -> DataFrame:
    """AGG-13 from profiles: (key, complete) of the keys with a row in the window; see ``prices.completeness``."""
    n = F.sum(rows_in(start, end)).alias("_n")
    kind = "float" if real else "double"
    counted = profiles.where(F.col("word").between(_day(start) // 64, _day(end) // 64)).groupBy(key).agg(n).where("_n > 0")
    return counted.select(key, (F.col("_n").cast(kind) / denominator.cast(kind)).cast(kind).alias("complete"))


__all__ = ["day_profiles", "merge_profiles", "rows_in", "completeness_of", "ORIGIN"]
