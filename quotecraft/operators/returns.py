"""Returns: RET-01 (strict, SQL form), RET-02 (grid, R form), RET-03 (monthly),
JON-03 (previous-price self join), CLN-05 and CLN-08 (extreme returns).

Two definitions are kept apart on purpose:

- strict (SQL): price over the price on the previous *trading day* of the
  calendar; no row when that price is missing; the quotient is taken in
  4-byte float, as PostgreSQL does for ``real / real``.
- grid (R): prices on the trading-day grid after LOCF; price over the
  previous grid row, in double; the first grid row dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import REASON_RETURN, RETURN_LIMIT


def real_ratio_minus_one(num: Column, den: Column) -> Column:
    """``num / den - 1.0`` with the quotient rounded to float32 first."""
    return (num / den).cast("float").cast("double") - F.lit(1.0)


def _cal_days(cal: DataFrame) -> DataFrame:
    # one row per day: broadcast by construction
    return F.broadcast(cal.select("date", "trading", "prev_trading_day"))


def prev_price_join(eod: DataFrame, cal: DataFrame) -> DataFrame:
    """JON-03: (symbol, date, adj_close, prev_date, prev_adj_close).

    The reference's three-way join: prices x calendar on date, then prices
    again on (symbol, prev_trading_day).  The calendar side is broadcast; the
    self join is an equi join on (symbol, date).
    """
    e = eod.alias("e").join(_cal_days(cal).alias("cc"), F.col("e.date") == F.col("cc.date"))
    p = eod.alias("p")
    return (e.join(p, (F.col("p.symbol") == F.col("e.symbol"))
                   & (F.col("p.date") == F.col("cc.prev_trading_day")))
            .select(F.col("e.symbol").alias("symbol"), F.col("e.date").alias("date"),
                    F.col("e.adj_close").alias("adj_close"), F.col("p.date").alias("prev_date"),
                    F.col("p.adj_close").alias("prev_adj_close")))


def strict_returns(eod: DataFrame, cal: DataFrame) -> DataFrame:
    """RET-01: (symbol, date, ret), same rows as the self join, one exchange.

    Rows strictly between a date's previous trading day and the date itself
    can only be non-trading-day rows, so the price on the previous trading
    day, when it exists, is the most recent earlier *trading-day* row of the
    symbol.  One window partitioned by symbol finds it -- instead of shuffling
    both sides of a self join.

    (symbol, date) must be a key of ``eod`` -- the primary key of the price
    tables, checked by ``quality.pk_violations``; with duplicate keys the self
    join would fan out where this form keeps one previous price.
    """
    x = eod.select("symbol", "date", "adj_close").join(_cal_days(cal), "date")
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    prev = F.last(F.when(F.col("trading") == 1, F.struct("date", "adj_close")), ignorenulls=True).over(w)
    x = x.withColumn("_p", prev)
    return (x.where(F.col("_p.date") == F.col("prev_trading_day"))
            .select("symbol", "date", real_ratio_minus_one(F.col("adj_close"), F.col("_p.adj_close")).alias("ret")))


def strict_returns_join(eod: DataFrame, cal: DataFrame) -> DataFrame:
    """RET-01 by the reference's self join (kept for comparison and bench)."""
    j = prev_price_join(eod, cal)
    return j.select("symbol", "date", real_ratio_minus_one(F.col("adj_close"), F.col("prev_adj_close")).alias("ret"))


def grid_returns(prices: DataFrame, value: str = "price", key: str = "symbol",
                 drop_first: bool = True) -> DataFrame:
    """RET-02: ``CalculateReturns`` on a grid, then ``tail(-1)``.

    ``value / lag(value) - 1`` in double per symbol; NULL where either price
    is missing; the first grid row dropped when ``drop_first``.
    """
    w = Window.partitionBy(key).orderBy("date")
    out = prices.select(key, "date", (F.col(value) / F.lag(value).over(w) - 1).alias("ret"),
                        F.row_number().over(w).alias("_rn"))
    if drop_first:
        out = out.where(F.col("_rn") > 1)
    return out.drop("_rn")


def lagged(prices: DataFrame, value: str, key: str = "symbol", n: int = 1) -> DataFrame:
    """WIN-03: the value n rows earlier on the ordered grid."""
    w = Window.partitionBy(key).orderBy("date")
    return prices.withColumn(f"prev_{value}", F.lag(value, n).over(w))


def monthly_strict_returns(eod: DataFrame, cal: DataFrame) -> DataFrame:
    """RET-03, SQL form: month-end price over the previous month-end price.

    The month-end calendar gets its own ``prev_trading_day`` = previous month
    end; the strict-return operator is then reused unchanged.
    """
    me = cal.where((F.col("trading") == 1) & (F.col("eom") == 1)).select("date")
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)   # <= 12 rows a year
    me_cal = me.select("date", F.lit(1).cast("smallint").alias("trading"),
                       F.max("date").over(w).alias("prev_trading_day"))
    px = eod.join(F.broadcast(me), "date", "left_semi")
    return strict_returns(px, me_cal)


def extreme_return_symbols(ret: DataFrame, limit: float = RETURN_LIMIT,
                           reason: str = REASON_RETURN) -> DataFrame:
    """CLN-05: (ticker, reason) for each symbol with some ret > limit."""
    return (ret.where(F.col("ret") > F.lit(float(limit))).select(F.col("symbol").alias("ticker"))
            .distinct().select("ticker", F.lit(reason).alias("reason")))


def column_max(ret: DataFrame, key: str = "symbol", value: str = "ret") -> DataFrame:
    """AGG-17 ``colMax``: largest value per series, NULLs ignored (NULL if none)."""
    return ret.groupBy(key).agg(F.max(value).alias(f"max_{value}"))


def drop_extreme_series(ret: DataFrame, limit: float = RETURN_LIMIT, key: str = "symbol") -> DataFrame:
    """CLN-08: keep series whose largest return is <= limit.

    An all-missing series has max = -Inf in R and is kept; here its max is
    NULL and it is kept the same way.  The maximum is a per-symbol window
    (bounded by the calendar), so the series is read once and, partitioned
    by symbol already, not shuffled again.
    """
    mx = F.max("ret").over(Window.partitionBy(key))
    return ret.withColumn("_mx", mx).where(F.col("_mx").isNull() | (F.col("_mx") <= F.lit(float(limit)))) \
        .drop("_mx")
