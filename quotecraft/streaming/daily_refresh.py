"""Daily refresh of strict returns with Structured Streaming.

The reference keeps every calendar day in its exports because "data is
updated daily" and re-runs its stored views.  This is the incremental form
of that step: new price files (symbol, date, adj_close) land in a folder, and
the stream keeps its symbols' prices by day, in one state per bucket of symbols.  A micro-batch

1. joins its rows to the calendar (one row per day): the trading day before, and
   the days whose trading day before this one is;
2. updates the prices and derives the strict returns (RET-01 semantics) that
   they touch: those of the new days, and those of days after them that came
   earlier (a late price fixes the return of the day after it), all symbols of a bucket
   at once in arrays;
3. appends a row (symbol, date, adj_close, ret, seq) for each.

A call of Python, its frames and its state have a price of about a millisecond: with one state
per symbol a batch took that for each of them, with buckets it takes it at most ``BUCKETS`` times.
A bucket's state is bounded by its symbols and the calendar, and a batch reads nothing but its own
files and the states of its buckets.  The row of the highest ``seq`` is the current one
(:func:`current_prices`, :func:`current_returns`).  State, progress and the list of written
files are in the stream's checkpoint and output log under the shared folder, so a replayed
batch neither counts twice nor leaves rows behind.  :func:`compact` writes the current rows as
a table of few files.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import new_table_path

PRICE_SCHEMA = "symbol string, date date, adj_close float"
_ROW = "symbol string, day int, adj_close float, ret double, has_ret boolean, seq long"
#: states of a stream; a checkpoint keeps its symbols' buckets, so another number needs a new one
BUCKETS = 1024
#: ``codes`` (places in ``symbols``) and ``days`` as int32, ``prices`` as float32, sorted by symbol and day
_STATE = "symbols array<string>, codes binary, days binary, prices binary, seq long"
_TABLE = "symbol string, date date, adj_close float, ret double, has_ret boolean, seq long"


def _neighbour_days(calendar: DataFrame) -> DataFrame:
    """(date, prev, nexts): day numbers of the trading day before a date and of the dates it comes before."""
    cal = calendar.select("date", "prev_trading_day")
    after = cal.where(F.col("prev_trading_day").isNotNull()).groupBy(F.col("prev_trading_day").alias("date")).agg(
        F.collect_list(F.unix_date("date")).alias("nexts"))       # a weekend or some holidays
    return cal.join(after, "date", "left").select(
        "date", F.unix_date("prev_trading_day").alias("prev"),
        F.coalesce("nexts", F.array().cast("array<int>")).alias("nexts"))


def _keys(codes: np.ndarray, days: np.ndarray) -> np.ndarray:
    """One number per symbol and day, in their order."""
    return (codes.astype("i8") << 32) + days.astype("i8") + (1 << 31)


def _places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted ``keys``, whether it is there) of each wanted key."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    symbols, codes, days, prices, seq = state.get if state.exists else ([], b"", b"", b"", 0)
    old = _keys(np.frombuffer(codes, "<i4"), np.frombuffer(days, "<i4"))
    pdf = pd.concat(list(batches), ignore_index=True)
    # known symbols keep their places
    code, names = pd.factorize(np.array(symbols + pdf["symbol"].tolist(), dtype=object), use_na_sentinel=False)
    names = [s if isinstance(s, str) else None for s in names]
    code, day = code[len(symbols):], pdf["day"].to_numpy()
    # two prices of one day in a batch: the larger, so that a replay keeps the same one
    new, first, back = np.unique(_keys(code, day), return_index=True, return_inverse=True)
    price = np.full(len(new), np.nan, "f4")
    np.fmax.at(price, back, pdf["adj_close"].to_numpy().astype("f4"))
    code, day = code[first], day[first]
    stay = ~np.isin(old, new)
    known, at_price = np.concatenate([old[stay], new]), np.concatenate([np.frombuffer(prices, "<f4")[stay], price])
    order = np.argsort(known, kind="stable")
    known, at_price = known[order], at_price[order]

    # the days of the batch: the trading day before, and the days that a price of theirs comes before
    _, some, of = np.unique(day, return_index=True, return_inverse=True)
    prev = pdf["prev"].to_numpy(dtype=float)[first][some]
    nexts = [np.asarray(n, dtype="i8") for n in pdf["nexts"].to_numpy()[first][some]]
    many, starts = np.array([len(n) for n in nexts]), np.cumsum([0] + [len(n) for n in nexts])
    each = np.repeat(np.arange(len(new)), many[of])
    within = np.arange(len(each)) - np.repeat(np.cumsum(many[of]) - many[of], many[of])
    later = _keys(code[each], np.concatenate([*nexts, np.empty(0, "i8")])[starts[of[each]] + within])
    came = _places(known, later)[1] & ~np.isin(later, new)
    each, later = each[came], later[came]

    before = prev[of]
    touched = np.concatenate([new, later])
    now = at_price[_places(known, touched)[0]]
    at, has = _places(known, np.concatenate([_keys(code, np.nan_to_num(before)), new[each]]))
    has &= np.concatenate([~np.isnan(before), np.ones(len(later), dtype=bool)])
    with np.errstate(divide="ignore", invalid="ignore"):
        ret = (now / at_price[at]).astype("f8") - 1.0
    seq = int(seq) + 1
    which = (touched >> 32)
    state.update((names, (known >> 32).astype("<i4").tobytes(), ((known & 0xFFFFFFFF) - (1 << 31)).astype("<i4").tobytes(),
                  at_price.astype("<f4").tobytes(), seq))
    yield pd.DataFrame({"symbol": np.array(names, dtype=object)[which], "day": ((touched & 0xFFFFFFFF) - (1 << 31)).astype("i4"),
                        "adj_close": now, "ret": np.where(has, ret, np.nan), "has_ret": has, "seq": np.full(len(touched), seq, "i8")})


def start_daily_refresh(spark: SparkSession, incoming: str, calendar: DataFrame, path: str, checkpoint: str,
                        files_per_batch: int = 1, available_now: bool = True) -> StreamingQuery:
    """Start the stream over ``incoming`` (parquet files of PRICE_SCHEMA in folders); rows go to ``path``."""
    # written once: a batch reads it instead of deriving the calendar again
    days = new_table_path(spark, "stream-days")
    _neighbour_days(calendar).write.parquet(days)
    src = (spark.readStream.schema(PRICE_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
           .parquet(f"{incoming.rstrip('/')}/*/*.parquet"))
    rows = src.join(F.broadcast(spark.read.parquet(days)), "date").select(    # one row per day
        "symbol", F.unix_date("date").alias("day"), F.col("adj_close").cast("float").alias("adj_close"), "prev", "nexts",
        F.pmod(F.hash("symbol"), F.lit(BUCKETS)).alias("bucket"))
    out = rows.groupBy("bucket").applyInPandasWithState(_advance, _ROW, _STATE, "append", GroupStateTimeout.NoTimeout)
    writer = (out.select("symbol", F.date_from_unix_date("day").alias("date"), "adj_close", "ret", "has_ret", "seq")
              .writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def _read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:         # nothing written yet; any other failure is a failure
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _current(spark: SparkSession, path: str) -> DataFrame:
    rows = _read_table(spark, path, _TABLE)
    last = F.max_by(F.struct("adj_close", "ret", "has_ret", "seq"), "seq").alias("_v")
    return rows.groupBy("symbol", "date").agg(last).select("symbol", "date", "_v.*")


def current_prices(spark: SparkSession, path: str) -> DataFrame:
    """Latest price per (symbol, date)."""
    return _current(spark, path).select("symbol", "date", "adj_close")


def current_returns(spark: SparkSession, path: str) -> DataFrame:
    """Latest strict return per (symbol, date) that has a price on the trading day before."""
    return _current(spark, path).where("has_ret").select("symbol", "date", "ret")


def compact(spark: SparkSession, path: str, to: str) -> str:
    """The current rows as one table, in ranges of symbol and date; the stream's own files stay as they are."""
    _current(spark, path).repartitionByRange("symbol", "date").sortWithinPartitions("symbol", "date").write.parquet(to)
    return to


def write_daily_files(prices: DataFrame, incoming: str, late: dt.date | None = None) -> str:
    """Split a price table into one folder per arriving day (test input), in one job.

    Days arrive oldest first, ``late`` last.  Folder ``arrival=<k>`` holds the k-th arrival; the stream
    reads ``<incoming>/*/*.parquet``, so Spark's own ``_temporary`` and marker files are never
    picked up.
    """
    # one row per date: bounded by the calendar
    dates = prices.select("date").distinct()
    order = dates.withColumn("arrival", F.row_number().over(
        Window.orderBy(F.col("date").eqNullSafe(F.lit(late).cast("date")), "date")))
    rows = prices.join(F.broadcast(order), "date").select("symbol", "date", "adj_close", "arrival")
    # a hot day is written by several tasks, each a file of its folder
    rows.repartitionByRange("arrival", "symbol").write.mode("overwrite").partitionBy("arrival").parquet(incoming)
    return incoming


__all__ = ["start_daily_refresh", "current_prices", "current_returns", "compact", "write_daily_files"]
