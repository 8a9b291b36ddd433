"""Series packed one row per symbol, day bitmaps, and the blocked covariance matrix.

A packed series is an ``array<double>`` on a shared day index: every series of a
study has the same length, so joining a universe to it moves one row per asset
instead of one per asset and day.  A day bitmap holds one bit per day, 64 days to a
word; the days on which all assets of a portfolio have a return are the AND of
their bitmaps.

The covariance of many assets is a Gram matrix in blocks: assets are cut into
blocks of columns, and every pair of blocks is a group of its own that multiplies two
matrices of (days x block).  No group holds more than two blocks and their product, however
many assets a portfolio has, and the groups of one portfolio are dealt out to many tasks.  A
product leaves Python as a few arrays; its pairs become rows in the JVM, so a pair costs eight
bytes on the way there, without its two names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: assets of one block of the covariance matrix: a series is sent once per block, a product is 8 MB
BLOCK = 1024
#: rows of a product that leave Python as one array (256 KB)
STRIP = 32
#: most tasks for the pairs of blocks of one matrix; with more pairs a task takes several, one after the other
TASKS = 2000
#: strip of a product, row by row; pairs count from the place ``least`` of ``right`` less that of ``left`` on
_STRIP = "portfolio_id long, least int, left array<string>, right array<string>, covs array<double>"


def day_index(df: DataFrame, test_rows: int, date_col: str = "date") -> DataFrame:
    """(date, day, part): the distinct dates numbered from 0, the last ``test_rows`` of them 'test'.

    One row per distinct date, so both windows are bounded by the calendar."""
    dates = df.select(date_col).distinct()
    up, down = Window.orderBy(F.col(date_col).asc()), Window.orderBy(F.col(date_col).desc())
    return dates.select(date_col, (F.row_number().over(up) - 1).alias("day"),
                        F.when(F.row_number().over(down) <= test_rows, "test").otherwise("train").alias("part"))


def dense(values: pa.ListArray, days: pa.ListArray, n_days: int) -> np.ndarray:
    """(rows, n_days) matrix, NaN where a row has no value for a day."""
    out = np.full((len(values), n_days), np.nan)
    sizes = np.diff(values.offsets.to_numpy())
    out[np.repeat(np.arange(len(values)), sizes), days.flatten().to_numpy(zero_copy_only=False)] = \
        values.flatten().to_numpy(zero_copy_only=False)
    return out


def pack_series(ret: DataFrame, n_days: int) -> DataFrame:
    """One row per symbol of ``ret`` (symbol, day, ret): (symbol, rets), ``rets`` an array of
    ``n_days`` doubles, NULL where the symbol has no return.

    A symbol has one row per day at most, so the collected list is bounded by the calendar."""
    some = ret.where(F.col("ret").isNotNull() & F.col("day").isNotNull())
    lists = (ret.select("symbol").distinct().join(
        some.groupBy("symbol").agg(F.collect_list(F.struct("day", "ret")).alias("_l")), "symbol", "left")
        .select("symbol", F.coalesce(F.col("_l.day"), F.array().cast("array<int>")).alias("_day"),
                F.coalesce(F.col("_l.ret"), F.array().cast("array<double>")).alias("_ret")))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = dense(batch.column("_ret"), batch.column("_day"), n_days)
            flat = pa.array(x.ravel(), mask=np.isnan(x.ravel()))
            rets = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * n_days, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("symbol"), rets], names=["symbol", "rets"])

    return lists.mapInArrow(fill, "symbol string, rets array<double>")


def day_bitmaps(ret: DataFrame, key: str = "symbol") -> DataFrame:
    """(key, word, bits): bit d % 64 of word d div 64 is set where the key has a return on day d."""
    return ret.where(F.col("ret").isNotNull()).groupBy(key, F.expr("cast(day div 64 as int)").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(day % 64 as int))")).alias("bits"))


def complete_days(universe: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(portfolio_id, words): the AND of the assets' bitmaps, as an array of words from day 0.

    ``words`` stops at the last word in which some day is complete."""
    sizes = universe.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("_n"))
    each = universe.join(bitmaps, "symbol").groupBy("portfolio_id", "word").agg(
        F.bit_and("bits").alias("bits"), F.count(F.lit(1)).alias("_k"))
    # a word that an asset lacks altogether has no complete day
    full = each.join(sizes, "portfolio_id").where("_k = _n AND bits <> 0")
    found = full.groupBy("portfolio_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("_m"))
    words = F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("_m"))), lambda w: F.coalesce(F.col("_m")[w], F.lit(0).cast("long")))
    return sizes.select("portfolio_id").join(found.select("portfolio_id", words.alias("words")), "portfolio_id", "left")


def days_of(words, n_days: int) -> np.ndarray:
    """Booleans per day of a bitmap."""
    out = np.zeros(n_days, dtype=bool)
    if words is not None and len(words):
        bits = np.unpackbits(np.asarray(words, dtype="<i8").view(np.uint8), bitorder="little")[:n_days]
        out[:len(bits)] = bits.astype(bool)
    return out


def pair_tasks(assets: int, block: int = BLOCK) -> int:
    """Tasks for the covariances of about ``assets`` assets: as many as pairs of blocks, ``TASKS`` at most."""
    n = -(-assets // block)
    return max(1, min(n * (n + 1) // 2, TASKS))


def covariance_blocks(universe: DataFrame, packed: DataFrame, complete: DataFrame | None, n_days: int,
                      block: int = BLOCK, both: bool = True, tasks: int | None = None) -> DataFrame:
    """PTF-03: sample covariances of each portfolio's assets over its complete days.

    ``both``: each pair in both orders; otherwise once, ``asset_a`` first in the order of the
    portfolio's assets by name.  ``complete``: see :func:`complete_days`; ``None``: every day counts
    (series without gaps).  NULL where a portfolio has fewer than two complete days.

    ``tasks``: partitions into which the pairs of blocks are dealt (see :func:`pair_tasks`), else the session's
    shuffle partitions.  A few MB of series become GB of pairs, so their number is fixed: left to itself Spark keeps
    a portfolio in the task that numbered its assets, or merges partitions by what goes in.
    """
    spread = int(universe.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = tasks or spread
    each = Window.partitionBy("portfolio_id")
    place = universe.distinct().where("portfolio_id IS NOT NULL").select(
        "portfolio_id", "symbol", (F.row_number().over(each.orderBy("symbol")) - 1).alias("place"),
        F.floor((F.count(F.lit(1)).over(each) - 1) / block).cast("int").alias("_last"))
    blocks = place.withColumn("_b", F.floor(F.col("place") / block).cast("int")).join(packed.select("symbol", "rets"), "symbol")
    every = complete is None
    blocks = blocks if every else blocks.join(complete, "portfolio_id", "left")
    # a block takes part in a group with every block of its portfolio, itself included; many tasks make these copies,
    # and no join follows, which might take them for as few as there are assets
    rows = (blocks.repartition(min(tasks, spread), "symbol").withColumn("_o", F.explode(F.sequence(F.lit(0), "_last")))
            .withColumns({"_i": F.least("_b", "_o"), "_j": F.greatest("_b", "_o")}).drop("_o", "_last"))

    def multiply(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        pid, i, j = (table.column(c)[0].as_py() for c in ("portfolio_id", "_i", "_j"))
        at = np.argsort(table.column("place").to_numpy(), kind="stable")
        b = table.column("_b").to_numpy()[at]
        names = np.array(table.column("symbol").to_pylist(), dtype=object)[at]
        rets = table.column("rets").combine_chunks()
        rets = rets.chunk(0) if isinstance(rets, pa.ChunkedArray) else rets
        x = rets.flatten().to_numpy(zero_copy_only=False).reshape(len(table), n_days)[at]
        x = x if every else x[:, days_of(table.column("words")[0].as_py(), n_days)]
        n = x.shape[1]
        left, right = b == i, b == j
        if n > 1:
            x = x - x.mean(axis=1, keepdims=True)
            cov = x[left] @ x[right].T / (n - 1)
        else:
            cov = np.full((int(left.sum()), int(right.sum())), np.nan)
        products = [(names[left], names[right], cov)]
        if both and i != j:
            products.append((names[right], names[left], cov.T))
        strips = [(a[k:k + STRIP], c, v[k:k + STRIP], k if i == j and not both else -block)
                  for a, c, v in products for k in range(0, len(a), STRIP)]
        flat = np.concatenate([np.empty(0)] + [v.ravel() for _, _, v, _ in strips])
        ends = np.cumsum([0] + [v.size for _, _, v, _ in strips])
        return pa.table({"portfolio_id": pa.array([pid] * len(strips), pa.int64()),
                         "least": pa.array([k for _, _, _, k in strips], pa.int32()),
                         "left": pa.array([a.tolist() for a, _, _, _ in strips], pa.list_(pa.string())),
                         "right": pa.array([c.tolist() for _, c, _, _ in strips], pa.list_(pa.string())),
                         "covs": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, mask=np.isnan(flat)))})

    pairs = (rows.repartition(tasks, "portfolio_id", "_i", "_j").groupBy("portfolio_id", "_i", "_j").applyInArrow(multiply, _STRIP)
             .select("*", F.posexplode("left").alias("_p", "asset_a"))
             .select("*", F.posexplode("right").alias("_q", "asset_b")).where("_q - _p >= least"))
    return pairs.select("portfolio_id", "asset_a", "asset_b",
                        F.get("covs", F.col("_p") * F.size("right") + F.col("_q")).alias("cov"))


def bundles(universe: DataFrame, packed: DataFrame) -> DataFrame:
    """One row per portfolio: (portfolio_id, symbols, series), its assets by name and their packed
    returns in the same order.  Bounded by assets x days of one portfolio."""
    one = universe.distinct().join(packed, "symbol").groupBy("portfolio_id").agg(
        F.array_sort(F.collect_list(F.struct("symbol", "rets"))).alias("_a"))
    return one.select("portfolio_id", F.col("_a.symbol").alias("symbols"), F.col("_a.rets").alias("series"))


def stacks(batch: pa.RecordBatch, n_days: int) -> Iterator[tuple[np.ndarray, list[list[str]], np.ndarray]]:
    """The portfolios of a batch of :func:`bundles` by their number of assets:
    (places in the batch, their symbols, returns as (portfolios, assets, days))."""
    series, symbols = batch.column("series"), batch.column("symbols")
    sizes = np.diff(series.offsets.to_numpy())
    x = series.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, n_days)
    first = np.cumsum(sizes) - sizes
    names = symbols.to_pylist()
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield at, [names[k] for k in at], x[first[at][:, None] + np.arange(n)]


__all__ = ["day_index", "pack_series", "day_bitmaps", "complete_days", "days_of", "pair_tasks", "covariance_blocks",
           "bundles", "stacks", "BLOCK"]
