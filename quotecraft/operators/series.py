"""Row-position operators on time series: SRT-04, PRJ-01, PRJ-06, PRJ-07, FLT-08.

R's ``head(x, n)``, ``tail(x, n)``, ``head(x, -n)``, ``tail(x, -n)`` count
rows of a wide table, i.e. *dates*.  In long form they become a rank over
the distinct dates (bounded by the calendar, so one small window) joined
back by broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _date_ranks(df: DataFrame, date_col: str = "date") -> DataFrame:
    dates = df.select(date_col).distinct()
    w_up = Window.orderBy(F.col(date_col).asc())
    w_down = Window.orderBy(F.col(date_col).desc())
    # one row per distinct date: bounded by the calendar
    return dates.select(date_col, F.row_number().over(w_up).alias("_up"),
                        F.row_number().over(w_down).alias("_down"))


def rows_by_date_position(df: DataFrame, n: int, which: str, date_col: str = "date") -> DataFrame:
    """SRT-04: ``head(x, n)`` ("head"), ``tail(x, n)`` ("tail"),
    ``head(x, -n)`` ("drop_last"), ``tail(x, -n)`` ("drop_first")."""
    r = _date_ranks(df, date_col)
    cond = {"head": F.col("_up") <= n, "tail": F.col("_down") <= n,
            "drop_last": F.col("_down") > n, "drop_first": F.col("_up") > n}[which]
    keep = r.where(cond).select(date_col)
    return df.join(F.broadcast(keep), date_col, "left_semi")


def train_test_split(df: DataFrame, test_rows: int, date_col: str = "date") -> DataFrame:
    """PTF-02: tag each row 'train' (all but the last n dates) or 'test'."""
    r = _date_ranks(df, date_col).select(date_col, F.when(F.col("_down") <= test_rows, "test")
                                          .otherwise("train").alias("part"))
    return df.join(F.broadcast(r), date_col)


def peek(df: DataFrame, n: int, order: Sequence[str], last: bool = False) -> DataFrame:
    """PRJ-01: ``head`` / ``tail`` / ``LIMIT n`` on a deterministic order."""
    cols = [F.col(c).desc() if last else F.col(c).asc() for c in order]
    return df.orderBy(*cols).limit(n)


def keep_series(df: DataFrame, symbols: DataFrame, key: str = "symbol") -> DataFrame:
    """PRJ-06 / JON-09: rows whose symbol is in a list (``%in%``), as a left semi join."""
    return df.join(symbols.select(key).distinct(), key, "left_semi")


def wide_shape(df: DataFrame, key: str = "symbol", date_col: str = "date") -> DataFrame:
    """PRJ-07: ``nrow`` / ``ncol`` of the wide form (dates x (symbols + date))."""
    return df.agg(F.countDistinct(date_col).alias("n_rows"),
                  (F.countDistinct(key) + F.lit(1)).alias("n_cols"))


def symbols_matching(df: DataFrame, pattern: str, key: str = "symbol") -> DataFrame:
    """FLT-08: ``grep(pattern, colnames)`` -- distinct symbols matching a regex."""
    return df.select(key).distinct().where(F.col(key).rlike(pattern))


def dense_index(df: DataFrame, key: str, buckets: int | None = None, out: str = "idx") -> DataFrame:
    """Number the distinct values of ``key`` 1..n by (md5 of the value, value).

    The order does not depend on ``buckets``: they are ranges of the md5 (about 10,000 values
    each unless given), numbered in parallel and shifted by the sizes of the ranges before.
    """
    vals = df.select(key).distinct().withColumn("_m", F.md5(F.col(key).cast("string").cast("binary")))
    n = F.lit(buckets) if buckets else F.greatest(F.ceil(vals.agg(F.count(F.lit(1))).scalar() / 10_000), F.lit(1))
    first = F.conv(F.substring("_m", 1, 8), 16, 10).cast("long")
    vals = vals.withColumn("_b", F.shiftright(first * n, 32).cast("long"))
    ranked = vals.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_m", key)))
    sizes = vals.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    # one row per range
    offsets = sizes.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_off"))
    return ranked.join(offsets, "_b").select(key, (F.col("_off") + F.col("_r")).alias(out))
