"""Trading calendar: TS-01, TS-02, WIN-01, WIN-02, JON-10, JON-12, JON-13.

The calendar has one row per day, so its size is bounded by the span of
dates it covers (at most 366 rows a year).  That bound is what lets the price
operators broadcast it; windows over it without ``partitionBy`` are fine for
the same reason and are used nowhere else.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..params import FIXED_HOLIDAYS
from ..session import new_table_path
from .relational import match_flag

CAL_COLUMNS = ["date", "y", "m", "d", "dow", "trading"]


def _holiday_codes(holidays: Iterable[tuple[int, int]]) -> list[int]:
    return [m * 100 + d for m, d in holidays]


def trading_flag(date: Column, holidays: Iterable[tuple[int, int]] = FIXED_HOLIDAYS) -> Column:
    """1 on weekdays that are not a fixed (month, day) holiday, else 0 (smallint)."""
    md = F.month(date) * 100 + F.dayofmonth(date)
    off = F.dayofweek(date).isin(1, 7) | md.isin(_holiday_codes(holidays))
    return F.when(off, F.lit(0)).otherwise(F.lit(1)).cast("smallint")


def calendar_from_dates(dates: DataFrame, holidays: Iterable[tuple[int, int]] = FIXED_HOLIDAYS,
                        holiday_dates: DataFrame | None = None) -> DataFrame:
    """TS-01: date, y, m, d, dow, trading for a one-column frame of dates.

    ``holiday_dates`` (one ``date`` column, a few rows a year) adds an
    exchange's own holiday list to the fixed ones.
    """
    cal = dates.select(
        F.col("date").cast("date").alias("date"),
        F.year("date").cast("int").alias("y"),
        F.month("date").cast("int").alias("m"),
        F.dayofmonth("date").cast("int").alias("d"),
        F.date_format("date", "EEE").alias("dow"),
        trading_flag(F.col("date"), holidays).alias("trading"),
    )
    if holiday_dates is not None:
        hol = holiday_dates.select(F.col("date").cast("date").alias("date"),
                                   F.lit(True).alias("_hol")).distinct()
        cal = (cal.join(F.broadcast(hol), "date", "left")
               .withColumn("trading", F.when(F.col("_hol"), F.lit(0).cast("smallint"))
                           .otherwise(F.col("trading")))
               .drop("_hol"))
    return cal


def trading_calendar(spark: SparkSession, start: str, end: str,
                     holidays: Iterable[tuple[int, int]] = FIXED_HOLIDAYS,
                     holiday_dates: DataFrame | None = None) -> DataFrame:
    """TS-01 over a fixed inclusive range (the spreadsheet's NETWORKDAYS.INTL)."""
    dates = spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    return calendar_from_dates(dates, holidays, holiday_dates)


def calendar_spanning(bounds: DataFrame, holidays: Iterable[tuple[int, int]] = FIXED_HOLIDAYS) -> DataFrame:
    """TS-01 + seed row over a data-derived span.

    ``bounds`` is a one-row frame (first_date, last_date).  The calendar runs
    from the last trading day strictly before ``first_date`` -- the seed row
    the reference inserts by hand so the first day gets a return -- through
    ``last_date``.  Everything stays lazy: no value reaches the driver.
    """
    # a year back: holidays repeat every year, so a year without a trading day means there is none at all
    back = bounds.select(
        "last_date",
        F.explode(F.sequence(F.date_sub("first_date", 366), F.date_sub("first_date", 1))).alias("date"))
    span = back.agg(F.max(F.when(trading_flag(F.col("date"), holidays) == 1, F.col("date"))).alias("start"),
                    F.max("last_date").alias("end"))
    missing = F.raise_error(F.lit("no trading day in the year before the first date")).cast("date")
    span = span.select(F.when(F.col("start").isNull() & F.col("end").isNotNull(), missing).otherwise(F.col("start")).alias("start"), "end")
    dates = span.select(F.explode(F.sequence("start", "end")).alias("date"))
    return calendar_from_dates(dates, holidays)


# --- WIN-01 / WIN-02: enrichment by windows --------------------------------

def with_prev_trading_day(cal: DataFrame) -> DataFrame:
    """WIN-01: greatest trading date strictly before each calendar date."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    return cal.withColumn("prev_trading_day",
                          F.max(F.when(F.col("trading") == 1, F.col("date"))).over(w))


def with_eom(cal: DataFrame) -> DataFrame:
    """WIN-02: eom = 1 on the last trading day of each (y, m), else 0."""
    w = Window.partitionBy("y", "m")
    last_d = F.max(F.when(F.col("trading") == 1, F.col("d"))).over(w)
    return cal.withColumn("eom", F.when(F.col("d") == last_d, 1).otherwise(0).cast("smallint"))


def enrich_calendar(cal: DataFrame) -> DataFrame:
    """TS-02: the calendar with eom and prev_trading_day, as the reference stores it."""
    return with_prev_trading_day(with_eom(cal)).select(*CAL_COLUMNS, "eom", "prev_trading_day")


# --- the join forms of the same enrichment --------------------------------

def month_end_flags(cal: DataFrame) -> DataFrame:
    """JON-10: (date, endofm), 1 on the last trading day of a month: a left join with a match flag."""
    ends = cal.where(F.col("trading") == 1).groupBy("y", "m").agg(F.max("date").alias("date"))
    return match_flag(cal, ends, ["date"], "endofm").select("date", "endofm")


def update_from(target: DataFrame, source: DataFrame, key: str | list[str],
                columns: list[str]) -> DataFrame:
    """JON-12: ``UPDATE target SET c = s.c FROM source s WHERE key = s.key``.

    Matched rows take the source value (NULL included); unmatched rows keep
    theirs.  A key that the source holds twice is an error: an UPDATE never
    adds rows.  The result is a new DataFrame to be written as a new version.
    """
    keys = [key] if isinstance(key, str) else list(key)
    one = F.when(F.count(F.lit(1)) == 1, F.lit(True)).otherwise(
        F.raise_error("update_from: the source holds a key more than once"))
    src = source.groupBy(*keys).agg(*[F.first(c).alias(f"_new_{c}") for c in columns], one.alias("_hit"))
    out = target.join(src, keys, "left")
    for c in columns:
        old = F.col(c) if c in target.columns else F.lit(None)
        out = out.withColumn(c, F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(old))
    order = target.columns + [c for c in columns if c not in target.columns]
    return out.select(*order)


def asof_backward(left: DataFrame, right: DataFrame, left_on: str, right_on: str,
                  value: str, out: str, by: list[str] | None = None,
                  strict: bool = True) -> DataFrame:
    """JON-13: as-of join -- for every left row, ``value`` of the right row with
    the greatest ``right_on`` < (or <=) ``left_on``, within ``by`` groups.

    Of right rows with the same key the greatest value counts; right rows with
    a null key match nothing, a left row with a null key gets NULL.

    Built as union + window (``last(..., ignorenulls)``) instead of the
    correlated subquery, which Spark would plan as a nested-loop join.  With
    ``by`` the window is partitioned by those keys.  Without, the rows are cut
    into ranges of the key; each range looks back inside itself, then at the
    last value of the ranges before it (one row per range), so no task sorts
    all rows.
    """
    by = by or []
    lcols = left.columns
    l_part = left.select(*[F.col(c) for c in lcols],
                         F.col(left_on).alias("_k"), F.lit(0 if strict else 1).alias("_side"),
                         F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    r_sel = right.where(F.col(right_on).isNotNull()).select(
        *[F.col(b) for b in by], F.col(right_on).alias("_k"), F.col(value).alias("_v"))
    r_part = r_sel.select(*[F.lit(None).cast(left.schema[c].dataType).alias(c)
                            if c not in by else F.col(c) for c in lcols],
                          "_k", F.lit(1 if strict else 0).alias("_side"), "_v")
    both = l_part.unionByName(r_part)
    order = ["_k", "_side", "_v"]
    if not by:
        # rows equal in the order are dealt on by their hash; written once, since
        # range bounds are sampled and must be the same for both readers
        spark = left.sparkSession
        path = new_table_path(spark, "asof-ranges")
        (both.repartitionByRange(*order, F.xxhash64(*lcols))
         .withColumn("_range", F.spark_partition_id()).write.parquet(path))
        both = spark.read.parquet(path)
        last = both.groupBy("_range").agg(
            F.max(F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_last"))
        before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        carried = last.select("_range", F.last("_last", ignorenulls=True).over(before)["_v"].alias("_carried"))
        # one row per range: bounded by the shuffle partitions
        both = both.join(F.broadcast(carried), "_range")
    w = Window.partitionBy(*(by or ["_range"])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = F.last("_v", ignorenulls=True).over(w)
    return (both.withColumn(out, found if by else F.coalesce(found, "_carried"))
            .where(F.col("_side") == (0 if strict else 1))
            .select(*lcols, out))


def prev_trading_day_asof(cal: DataFrame) -> DataFrame:
    """JON-13 on the calendar: (date, ptd) via :func:`asof_backward`."""
    days = cal.select("date")
    trading = cal.where(F.col("trading") == 1).select(F.col("date").alias("tdate"))
    return asof_backward(days, trading, "date", "tdate", "tdate", "ptd")
