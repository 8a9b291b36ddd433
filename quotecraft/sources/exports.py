"""Exports: SRC-16..19.

The reference left-joins the calendar to a stored view so that no trading day
is missed, then downloads CSV.  Here the days are broadcast to the priced
table, and days without any row are added; the CSV goes to the shared folder with a header and comma
delimiter and is read back with the declared schema.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prices import in_window, pivot_wide, wide_blocks, wide_to_long
from ..params import StudyWindow
from ..session import new_table_path
from . import loaders


def calendar_export(cal: DataFrame, table: DataFrame, w: StudyWindow, eom_only: bool = False,
                    keep_date: bool = False) -> DataFrame:
    """SRC-16/17/18, JON-11: trading days of the window LEFT JOIN a table.

    ``keep_date=False`` is the reference's ``SELECT PR.*``: a trading day with
    no row becomes one all-NULL row.  ``keep_date=True`` adds the calendar
    date, so such a day stays identifiable.
    """
    days = in_window(cal.where(F.col("trading") == 1), w.start, w.end)
    if eom_only:
        days = days.where(F.col("eom") == 1)
    days = days.select("date")
    # at most 366 days a year: prices are filtered where they lie, never shuffled by date
    held = table.join(F.broadcast(days), "date", "left_semi")
    # days without any row (the distinct dates combine map-side)
    empty = days.join(table.select("date").distinct(), "date", "left_anti")
    for c in table.columns:
        if c != "date":
            empty = empty.withColumn(c, F.lit(None).cast(table.schema[c].dataType))
    if not keep_date:
        empty = empty.withColumn("date", F.lit(None).cast(table.schema["date"].dataType))
        return held.select(*table.columns).unionByName(empty)
    return held.unionByName(empty).select("date", *[c for c in table.columns if c != "date"])


def export_round_trip(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as CSV (header, comma) to a fresh shared location; read it back
    with ``df``'s own schema."""
    path = loaders.write_csv(df, new_table_path(spark, name))
    return (spark.read.schema(df.schema).option("header", "true").option("sep", ",")
            .option("quote", '"').option("escape", '"').csv(path))


def wide_csv_round_trip(spark: SparkSession, long: DataFrame, symbols: Sequence[str], value: str = "ret",
                        name: str = "eod_ret") -> DataFrame:
    """SRC-19: pivot to date x symbol (TS-03), write CSV, read it back."""
    wide = pivot_wide(long, symbols, value)
    return export_round_trip(spark, wide, name)


def wide_csv_all_series(spark: SparkSession, long: DataFrame, value: str = "ret",
                        name: str = "eod_ret") -> DataFrame:
    """SRC-19 with every series: one wide CSV per block of columns, read back
    as one row per cell (date, symbol, ``value``)."""
    cells = long.select("date", "symbol", value).limit(0)
    for wide in wide_blocks(long, value):
        cells = cells.unionByName(wide_to_long(export_round_trip(spark, wide, name), value))
    return cells
