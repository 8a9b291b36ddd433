"""Mean-variance portfolios over many portfolios at once: PTF-01..08, TS-10.

The reference solves one 16-asset problem.  Here a portfolio is a set of
(portfolio_id, symbol) rows, and every step is a Spark job over all
portfolios:

1. universe   (portfolio_id, symbol): a fixed list or seeded draws
2. pack       one row per symbol with its returns as an array on the day index
3. split      the last ``test_rows`` dates are held out (one small date rank)
4. moments    means and blocked covariances over the days on which every asset
              of the portfolio has a return (day bitmaps, ``packed``)
5. target     mean training return of the benchmark, or the assets' mean
6. solve      one row per portfolio (its packed series); a batch of portfolios is
              one stack of matrices: min w'Sw  s.t.  sum(w) = 1, w'mu = target;
              without short positions by the critical line algorithm
7. apply      daily portfolio return on the test dates = sum(w * r)

A portfolio's row is bounded by (days x assets), whatever the size of the market.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..params import BENCHMARK, TEST_ROWS
from .critical_line import long_only as min_variance_long_only
from .packed import bundles, stacks
from .series import dense_index, train_test_split

WEIGHT_SCHEMA = "portfolio_id long, symbol string, weight double, status string"


# --- 1. universe ---------------------------------------------------------------------

def fixed_universe(spark: SparkSession, symbols: Sequence[str], portfolio_id: int = 0) -> DataFrame:
    """PTF-01 / TS-10: one portfolio of listed symbols (the script's ``tickers``)."""
    return spark.createDataFrame([(int(portfolio_id), s) for s in symbols], "portfolio_id long, symbol string")


def drawn_places(portfolio_id: Column, size: Column, n: int, seed: int) -> Column:
    """``n`` different numbers of 1..``size`` as an array, by Floyd's draw: for j from
    size - n + 1 to size take a number t of 1..j, and j itself where t is taken already.

    t is 1 + (the first 60 bits of md5('seed,portfolio,j') mod j): the same in any engine."""
    def step(taken: Column, j: Column) -> Column:
        text = F.concat_ws(",", F.lit(str(seed)), portfolio_id.cast("string"), j.cast("string"))
        t = F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), j) + 1
        return F.concat(taken, F.array(F.when(F.array_contains(taken, t), j).otherwise(t)))
    return F.aggregate(F.sequence(size - n + 1, size), F.array().cast("array<bigint>"), step)


def sampled_universe(symbols: DataFrame, n_portfolios: int, n_assets: int, seed: int = 100,
                     include: Sequence[str] = ()) -> DataFrame:
    """TS-10 (sampled): ``n_portfolios`` seeded random draws of ``n_assets``
    distinct symbols each (``sample(colnames, n)``; a smaller pool is an error), plus ``include`` symbols
    in every portfolio (the benchmark, in the script).

    Symbols are numbered 1..n by the md5 of their names (:func:`series.dense_index`, in
    parallel), and each portfolio draws its numbers by itself: no portfolio x symbol
    product is formed, and any engine with md5 repeats the draw.
    R's generator is not reproduced.
    """
    pool = symbols.select("symbol").distinct()
    if include:
        pool = pool.where(~F.col("symbol").isin(list(include)))
    numbered = dense_index(pool, "symbol")
    ids = symbols.sparkSession.range(n_portfolios).select(
        F.col("id").alias("portfolio_id"), pool.agg(F.count(F.lit(1))).scalar().alias("_n"))
    able = ids.withColumn("_n", F.when(F.col("_n") >= n_assets, F.col("_n")).otherwise(F.raise_error(
        F.format_string(f"cannot draw {n_assets} distinct symbols from a pool of %d", "_n")).cast("long")))
    picks = able.select("portfolio_id", F.explode(drawn_places(F.col("portfolio_id"), F.col("_n"), n_assets, seed)).alias("idx"))
    out = picks.join(numbered, "idx").select("portfolio_id", "symbol")
    if include:
        extra = ids.select("portfolio_id", F.explode(F.array(*[F.lit(s) for s in include])).alias("symbol"))
        out = out.unionByName(extra)
    return out


# --- 2-5. returns, split, complete dates, target -----------------------------------------

def portfolio_returns(universe: DataFrame, ret: DataFrame,
                      columns: tuple[str, ...] = ("date", "ret")) -> DataFrame:
    """(portfolio_id, symbol, date, ret) for every asset of every portfolio.

    One equi-join at every size, without hints: the planner broadcasts a
    universe below the session's threshold, and beyond it AQE splits the
    partition of a symbol that sits in every portfolio (the benchmark does).
    """
    cols = list(columns)
    return universe.join(ret.select("symbol", *cols), "symbol").select("portfolio_id", "symbol", *cols)


def split_returns(pret: DataFrame, test_rows: int = TEST_ROWS) -> DataFrame:
    """PTF-02: tag rows 'train' / 'test' by the last ``test_rows`` dates."""
    return train_test_split(pret, test_rows)


def complete_rows(pret: DataFrame) -> DataFrame:
    """PTF-03: keep dates on which every asset of the portfolio has a return.

    Two small aggregations (assets per portfolio, returns per portfolio-day)
    and a semi join; no per-group collection."""
    sizes = pret.select("portfolio_id", "symbol").distinct().groupBy("portfolio_id") \
        .agg(F.count(F.lit(1)).alias("_n"))
    per_day = pret.groupBy("portfolio_id", "date").agg(F.count("ret").alias("_k"))
    ok = per_day.join(sizes, "portfolio_id").where(F.col("_k") == F.col("_n")).select("portfolio_id", "date")
    return pret.join(ok, ["portfolio_id", "date"], "left_semi")


def benchmark_target(train: DataFrame, bench_ret: DataFrame, universe: DataFrame) -> DataFrame:
    """PTF-06: target = mean benchmark return over each portfolio's training dates."""
    dates = train.select("portfolio_id", "date").distinct()
    b = bench_ret.select("date", F.col("ret").alias("_rb"))
    return dates.join(b, "date").groupBy("portfolio_id").agg(F.avg("_rb").alias("target"))


def shared_target(bench_train: DataFrame, universe: DataFrame) -> DataFrame:
    """PTF-06 when all portfolios share one training period: the benchmark's
    mean over it is one scalar (a scalar subquery), attached per portfolio."""
    mar = bench_train.agg(F.avg("ret")).scalar()
    return universe.select("portfolio_id").distinct().select("portfolio_id", mar.alias("target"))


def asset_means(train_complete: DataFrame) -> DataFrame:
    """PTF-03: mean training return per (portfolio_id, symbol)."""
    return train_complete.groupBy("portfolio_id", "symbol").agg(F.avg("ret").alias("mean"))


# --- 6. the solve --------------------------------------------------------------------------

def moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, sample covariances and number of complete days of a stack (portfolios, assets, days)."""
    full = ~np.isnan(x).any(axis=1, keepdims=True)
    n = full.sum(axis=(1, 2))
    mu = np.where(full, x, 0.0).sum(axis=2) / np.maximum(n, 1)[:, None]
    away = np.where(full, x - mu[:, :, None], 0.0)
    cov = away @ away.transpose(0, 2, 1) / np.maximum(n - 1, 1)[:, None, None]
    return mu, cov, n


def min_variance_stack(mu: np.ndarray, cov: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bordered systems of a stack of equality-constrained minimum-variance problems:
    (weights, solved).  A NaN target drops the return constraint (global minimum variance).

    Matrices are judged singular after scaling: variances by their mean, means by
    their distance from the average mean.
    """
    count, n = mu.shape
    weights, solved = np.full((count, n), np.nan), np.zeros(count, dtype=bool)
    free = np.isnan(target)
    with np.errstate(all="ignore"):
        c = cov / np.einsum("bii->b", cov)[:, None, None] * n
        middle = mu.mean(axis=1)
        spread = np.abs(mu - middle[:, None]).max(axis=1)
        m, t = (mu - middle[:, None]) / spread[:, None], (target - middle) / spread
    for some, rows in ((free, 1), (~free, 2)):
        at = np.flatnonzero(some)
        if not len(at):
            continue
        k = np.zeros((len(at), n + rows, n + rows))
        k[:, :n, :n] = 2.0 * c[at]
        k[:, :n, n] = k[:, n, :n] = 1.0
        rhs = np.zeros((len(at), n + rows, 1))
        rhs[:, n] = 1.0
        if rows == 2:
            k[:, :n, n + 1] = k[:, n + 1, :n] = m[at]
            rhs[:, n + 1, 0] = t[at]
        ok = np.isfinite(k).all(axis=(1, 2)) & np.isfinite(rhs).all(axis=(1, 2))
        ok[ok] = np.linalg.cond(k[ok]) < 1e14
        weights[at[ok]] = np.linalg.solve(k[ok], rhs[ok])[:, :n, 0]
        solved[at[ok]] = True
    return weights, solved


def min_variance(mu: np.ndarray, cov: np.ndarray, target: float | None) -> tuple[np.ndarray | None, str]:
    """One problem of :func:`min_variance_stack`; ``target=None`` drops the return constraint."""
    w, solved = min_variance_stack(np.asarray(mu, dtype=float)[None], np.atleast_2d(np.asarray(cov, dtype=float))[None],
                                   np.array([np.nan if target is None else target]))
    return (w[0], "optimal") if solved[0] else (None, "singular")


#: targets besides a given one
NAIVE = "naive"


def solve_weights(universe: DataFrame, packed: DataFrame, n_days: int, n_train: int,
                  target: Column | str | None, long_only: bool = False) -> DataFrame:
    """PTF-04 / PTF-05: (portfolio_id, symbol, weight, status) per portfolio.

    ``packed``: the series (:func:`packed.pack_series`), ``n_days`` long, of which the first
    ``n_train`` are learned from; days on which an asset has no return are left out.
    ``target``: a scalar column (one target for all), ``NAIVE`` (the mean of the portfolio's
    asset means), or ``None`` (least variance at any mean).  Singular or infeasible
    problems give NULL weights and their status instead of failing the job.
    """
    naive = isinstance(target, str)
    goal = F.lit(None).cast("double") if target is None or naive else target
    rows = bundles(universe, packed).withColumn("target", goal)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("portfolio_id").to_numpy()
            goals = batch.column("target").to_numpy(zero_copy_only=False).astype(float)
            for at, names, x in stacks(batch, n_days):
                mu, cov, days = moments(x[:, :, :n_train])
                t = mu.mean(axis=1) if naive else goals[at]
                few = days < 2
                if long_only:
                    got = [min_variance_long_only(m, c, None if np.isnan(g) else float(g)) for m, c, g in zip(mu, cov, t, strict=True)]
                    w = np.array([np.full(mu.shape[1], np.nan) if v is None else v for v, _ in got])
                    status = np.array([s for _, s in got], dtype=object)
                else:
                    w, solved = min_variance_stack(mu, cov, t)
                    status = np.where(solved, "optimal", "singular").astype(object)
                w[few], status[few] = np.nan, "too_few_dates"
                n, flat = mu.shape[1], w.ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[at], n)), pa.array([s for row in names for s in row], pa.string()),
                     pa.array(flat, mask=np.isnan(flat)), pa.array(np.repeat(status, n), pa.string())],
                    names=["portfolio_id", "symbol", "weight", "status"])

    return rows.mapInArrow(solve, WEIGHT_SCHEMA)


def optimality(train_complete: DataFrame, target: DataFrame, weights: DataFrame, bounded: bool = False) -> DataFrame:
    """How well solved weights meet their problem, per portfolio: n_assets, status,
    sum_weights, gap (expected return against the target, over the largest mean),
    least_weight and kkt.

    At the minimum variance each held asset's covariance with the portfolio is a line
    in the asset's mean, and (``bounded``: weights not below zero) an asset left out lies on
    it or above.  ``kkt`` is the largest distance from that over the largest
    covariance.  The covariance with the portfolio's own return takes the place of the
    matrix, so no pairs of assets are made.
    """
    held = train_complete.join(weights, ["portfolio_id", "symbol"])
    day = Window.partitionBy("portfolio_id", "date")
    each = (held.withColumn("_own", F.sum(F.col("weight") * F.col("ret")).over(day)).groupBy("portfolio_id", "symbol").agg(
        F.avg("ret").alias("_mu"), F.covar_samp("ret", "_own").alias("_g"), F.max("weight").alias("_w"), F.max("status").alias("_status")))
    in_use = F.col("_w") > 1e-9 if bounded else F.lit(True)
    # one row per asset of the portfolio
    whole = Window.partitionBy("portfolio_id")
    each = each.withColumns({"_in": in_use, "_gi": F.when(in_use, F.col("_g")), "_mi": F.when(in_use, F.col("_mu"))})
    each = each.withColumns({"_slope": F.regr_slope("_gi", "_mi").over(whole), "_g1": F.max("_gi").over(whole),
                             "_m1": F.max("_mi").over(whole)})
    # a single held asset leaves the slope open: the least one that the assets of lower mean allow, else
    # the largest that those of higher mean allow
    edge = (F.col("_g") - F.col("_g1")) / (F.col("_mu") - F.col("_m1"))
    low, high = F.max(F.when(F.col("_mu") < F.col("_m1"), edge)).over(whole), F.min(F.when(F.col("_mu") > F.col("_m1"), edge)).over(whole)
    each = each.withColumn("_slope", F.coalesce("_slope", low, high, F.lit(0.0)))
    each = each.withColumn("_at", F.avg(F.col("_gi") - F.col("_slope") * F.col("_mi")).over(whole))
    off = F.col("_g") - F.col("_at") - F.col("_slope") * F.col("_mu")
    line = each.withColumn("_off", F.when(F.col("_in"), F.abs(off)).otherwise(F.greatest(-off, F.lit(0.0)))).groupBy("portfolio_id").agg(
        F.count(F.lit(1)).alias("n_assets"), F.max("_status").alias("status"), F.sum("_w").alias("sum_weights"),
        F.sum(F.col("_w") * F.col("_mu")).alias("_mean"), F.max(F.abs("_mu")).alias("_top"),
        F.min("_w").alias("least_weight"), F.max("_off").alias("_off"), F.max(F.abs("_g")).alias("_most"))
    return line.join(target, "portfolio_id").select(
        "portfolio_id", "n_assets", "status", "sum_weights",
        (F.abs(F.col("_mean") - F.col("target")) / F.col("_top")).alias("gap"), "least_weight",
        (F.col("_off") / F.col("_most")).alias("kkt"))


# --- 7-8. apply and compare ----------------------------------------------------------------

def apply_weights(weights: DataFrame, packed: DataFrame, days: DataFrame, n_days: int, n_train: int) -> DataFrame:
    """PTF-07: daily portfolio return sum(w * r) on the days after the first ``n_train``; NULL on a
    date when an asset has no return.

    The weights meet one row per symbol; only the held-out days are spread to rows."""
    late = packed.select("symbol", F.slice("rets", n_train + 1, max(n_days - n_train, 1)).alias("_r"))
    rows = weights.join(late, "symbol").select("portfolio_id", "weight", F.posexplode("_r").alias("_k", "ret"))
    sums = rows.groupBy("portfolio_id", (F.col("_k") + n_train).alias("day")).agg(
        F.when(F.count("ret") == F.count(F.lit(1)), F.sum(F.col("weight") * F.col("ret"))).alias("ret"))
    # one row per day
    return sums.join(F.broadcast(days.select("day", "date")), "day").select("portfolio_id", "date", "ret")


def with_benchmark(port_ret: DataFrame, bench_test: DataFrame, label: str = "ptf",
                   bench: str = BENCHMARK) -> DataFrame:
    """PTF-08: portfolio and benchmark test series side by side, long form
    (portfolio_id, series, date, ret) -- ``Rp`` of the script."""
    dates = port_ret.select("portfolio_id", "date")
    b = dates.join(bench_test.select("date", "ret"), "date").select("portfolio_id", F.lit(bench).alias("series"), "date", "ret")
    p = port_ret.select("portfolio_id", F.lit(label).alias("series"), "date", "ret")
    return p.unionByName(b)
