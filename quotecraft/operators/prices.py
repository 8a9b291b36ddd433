"""Price tables: windows, unions, completeness, exclusions, grid and LOCF.

Covers SRC-05, FLT-02, SET-02, AGG-13, CLN-04/06/09, TS-03/04/05/06/08/09.
Prices are kept long -- (symbol, date, adj_close) -- which is the canonical
form of the library; the wide (date x symbol) form appears only at export.

Scale notes: every per-symbol window is partitioned by symbol and holds at
most one row per calendar day, so no window group outgrows the calendar.
Joins to the calendar broadcast it (one row per day, see ``calendar``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import MAX_GAP, REASON_MISSING, StudyWindow

#: series of one wide table: each block of columns is planned and written on its own
WIDE_BLOCK = 1000


def in_window(df: DataFrame, start: str, end: str, date_col: str = "date") -> DataFrame:
    """FLT-02: inclusive BETWEEN on a date column (pushed to the parquet scan)."""
    return df.where(F.col(date_col).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def quotes_view(quotes: DataFrame, w: StudyWindow) -> DataFrame:
    """v_eod_quotes: (ticker, date, adj_close) inside the window."""
    return in_window(quotes, w.start, w.end).select("ticker", "date", "adj_close")


def indices_view(indices: DataFrame, w: StudyWindow) -> DataFrame:
    """v_eod_indices: (symbol, date, adj_close) inside the window."""
    return in_window(indices, w.start, w.end).select("symbol", "date", "adj_close")


def union_distinct(first: DataFrame, second: DataFrame, key: str | None = None) -> DataFrame:
    """SET-02: SQL ``UNION`` -- by position, names of the first, duplicates removed.

    The de-duplication is hashed on all columns, so copies of one hot symbol
    (a file loaded twice) spread over many tasks; only after it -- when a
    symbol holds at most one row per source and day -- is the result
    partitioned by ``key``, once, for every later per-key step (windows,
    grouped aggregates by key) to reuse.
    """
    out = first.union(second).distinct()
    return out.repartition(key) if key is not None else out


def trading_day_count(cal: DataFrame, start: str, end: str) -> Column:
    """Scalar subquery: trading days in [start, end] (evaluated once)."""
    return in_window(cal.where(F.col("trading") == 1), start, end).agg(F.count(F.lit(1))).scalar()


def completeness(prices: DataFrame, key: str, denominator: Column, real: bool = True) -> DataFrame:
    """AGG-13: (key, complete) = rows per key / denominator.

    ``real=True`` divides in 4-byte float as ``count(*)::real / n::real``;
    ``real=False`` divides in double (the R form).
    """
    n = F.count(F.lit(1))
    if real:
        ratio = (n.cast("float") / denominator.cast("float")).cast("float")
    else:
        ratio = n.cast("double") / denominator.cast("double")
    return prices.groupBy(key).agg(ratio.alias("complete"))


def missing_exclusions(view: DataFrame, cal: DataFrame, w: StudyWindow,
                       threshold: float | None = None, key: str = "ticker",
                       reason: str = REASON_MISSING) -> DataFrame:
    """CLN-04 / CLN-09: (ticker, reason) for series below the completeness limit.

    The denominator is the window's trading days, seed day included.
    """
    thr = w.threshold if threshold is None else threshold
    comp = completeness(view, key, trading_day_count(cal, w.start, w.end))
    return comp.where(F.col("complete") < F.lit(float(thr))).select(
        F.col(key).alias("ticker"), F.lit(reason).alias("reason"))


def apply_exclusions(indices_v: DataFrame, quotes_v: DataFrame, exclusions: DataFrame) -> DataFrame:
    """CLN-06: both views without excluded symbols, combined by UNION.

    ``a WHERE s NOT IN x UNION b WHERE s NOT IN x`` is computed as
    ``(a UNION b) WHERE s NOT IN x``: the filter distributes over the union,
    so one anti join serves both sources.  ``NOT IN`` becomes a left anti
    join: exclusion tickers are a primary key, never NULL.  The exclusion
    list is small (at most one row per symbol); AQE broadcasts it once it has
    measured it, so the anti join runs map-side before the de-duplicating
    shuffle.
    """
    ex = exclusions.select(F.col("ticker").alias("_x")).distinct()
    both = indices_v.select("symbol", "date", "adj_close").union(
        quotes_v.select(F.col("ticker").alias("symbol"), "date", "adj_close"))
    kept = both.join(ex, F.col("symbol") == F.col("_x"), "left_anti")
    return kept.distinct().repartition("symbol")


# --- the R path: grid, LOCF ---------------------------------------------------

def completeness_r(eod: DataFrame, cal: DataFrame, w: StudyWindow) -> DataFrame:
    """AGG-13, R form: rows per symbol / (trading days in window - 1)."""
    return completeness(eod, "symbol", trading_day_count(cal, w.start, w.end) - 1, real=False) \
        .withColumnRenamed("complete", "pct")


def select_complete(eod: DataFrame, denominator: Column, threshold: float, key: str = "symbol",
                    real: bool = False) -> DataFrame:
    """TS-08: rows of series whose completeness reaches the threshold
    (``eod[symbol %in% names(pct)[pct >= thr]]``).

    Computed with a per-symbol window count instead of an aggregate joined
    back, so the input is read once; on input partitioned by symbol (the
    UNION of the study) this adds no exchange.  Same ratio as
    :func:`completeness`.
    """
    x = eod.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    n = F.col("_n")
    if real:
        ratio = (n.cast("float") / denominator.cast("float")).cast("float")
    else:
        ratio = n.cast("double") / denominator.cast("double")
    return x.where(ratio >= F.lit(float(threshold))).drop("_n")


def trading_days(cal: DataFrame, start: str, end: str, month_end: bool = False) -> DataFrame:
    days = cal.where(F.col("trading") == 1)
    if month_end:
        days = days.where(F.col("eom") == 1)
    return in_window(days, start, end).select("date")


def price_grid(eod: DataFrame, cal: DataFrame, start: str, end: str,
               value: str = "adj_close", days: DataFrame | None = None, key: str = "symbol") -> DataFrame:
    """TS-04 (+ AGG-18): every trading day x every symbol, price or NULL.

    Duplicate cells are averaged (``dcast(fun.aggregate=mean)``).  One pass
    per symbol: its cells become a date -> price map (at most one entry per
    trading day, so bounded by the calendar), and the trading-day list -- a
    scalar array subquery over the calendar -- is exploded against it.  No
    cross join, no join back to the cells, and on input partitioned by
    symbol no exchange.
    """
    day_list = days if days is not None else trading_days(cal, start, end)
    ds = day_list.agg(F.sort_array(F.collect_list("date")).alias("ds")).scalar()
    cells = eod.groupBy(key, "date").agg(F.avg(value).alias("px"))
    per_symbol = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("date", "px"))).alias("_m"))
    return per_symbol.select(key, F.explode(ds).alias("date"), "_m") \
        .select(key, "date", F.element_at("_m", F.col("date")).alias("px"))


def locf(grid: DataFrame, maxgap: int = MAX_GAP, value: str = "px", out: str = "price",
         key: str = "symbol", order: str = "date") -> DataFrame:
    """TS-05: last observation carried forward over runs of <= maxgap missing.

    Gaps-and-islands: the island id is the running count of observations; a
    run is filled only when the island's whole NULL run is <= maxgap; leading
    NULLs (island 0) stay NULL.  Both windows partition by ``key`` first, so
    Spark plans one exchange.
    """
    w_run = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    w_island = Window.partitionBy(key, "_grp")
    g = grid.withColumn("_grp", F.count(value).over(w_run))
    gap = F.count(F.when(F.col(value).isNull(), 1)).over(w_island)
    carried = F.last(value, ignorenulls=True).over(w_run)
    filled = F.when(F.col(value).isNotNull(), F.col(value)) \
        .when((F.col("_grp") > 0) & (gap <= maxgap), carried)
    return g.withColumn(out, filled).drop("_grp")


def pivot_wide(long: DataFrame, symbols: Sequence[str], value: str, index: str = "date",
               key: str = "symbol") -> DataFrame:
    """TS-03: long -> wide with one column per listed symbol (mean of duplicates).

    The symbol list is explicit, so Spark does not collect distinct values to
    the driver; it plans one grouped aggregation by ``index``.
    """
    return long.groupBy(index).pivot(key, list(symbols)).agg(F.avg(value))


def kept_series(long: DataFrame, key: str = "symbol") -> list[str]:
    """The symbols of ``long`` in order: the columns of its whole wide form.

    A wide table names its columns in the plan, so this list is the one thing
    that comes to the driver; it grows with the series, not with the rows.
    """
    names = long.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key)
    return [r[0] for r in names.collect()]


def wide_blocks(long: DataFrame, value: str, index: str = "date", key: str = "symbol",
                block: int = WIDE_BLOCK) -> list[DataFrame]:
    """TS-03 with every series: the wide table cut into blocks of ``block`` columns.

    Each block holds every date of ``long`` and reads only its own range of
    symbols.  An empty ``long`` has no block.
    """
    names = kept_series(long, key)
    dates = long.select(index).distinct()
    out = []
    for at in range(0, len(names), block):
        mine = names[at:at + block]
        wide = pivot_wide(long.where(F.col(key).between(mine[0], mine[-1])), mine, value, index, key)
        out.append(dates.join(wide, index, "left"))
    return out


def wide_to_long(wide: DataFrame, value: str, index: str = "date", key: str = "symbol") -> DataFrame:
    """Undo the pivot: one row per cell, empty cells as NULL."""
    cells = ["`" + c.replace("`", "``") + "`" for c in wide.columns if c != index]
    return wide.unpivot([index], cells, key, value)


def wide_cells(long: DataFrame, value: str) -> DataFrame:
    """Every cell (date, symbol, ``value``) of the whole wide table, pivoted block by block."""
    cells = long.select("date", "symbol", value).limit(0)
    for wide in wide_blocks(long, value):
        cells = cells.unionByName(wide_to_long(wide, value))
    return cells


def month_end_rows(prices: DataFrame, cal: DataFrame) -> DataFrame:
    """TS-06: price rows on month-end trading days (calendar eom = 1)."""
    eom = cal.where((F.col("trading") == 1) & (F.col("eom") == 1)).select("date")
    return prices.join(F.broadcast(eom), "date", "left_semi")


def align_on_date(assets: DataFrame, bench: DataFrame, value: str = "ret",
                  key: str = "symbol") -> DataFrame:
    """TS-09: each asset row next to the benchmark's value on the same date."""
    b = F.broadcast(bench.select("date", F.col(value).alias(f"{value}_b")))   # one row per date
    return assets.join(b, "date").select(key, "date", value, f"{value}_b")
