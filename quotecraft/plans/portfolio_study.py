"""The portfolio study as one lazily built object (stock_r's last part).

``PortfolioStudy.fixed`` is the script's case -- one portfolio of listed
assets; ``PortfolioStudy.sampled`` runs many seeded portfolios at once.

Steps that later steps read more than once are tables in the shared folder: the day
index, the tagged returns, the packed series, a drawn universe, the weights.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import packed as pk
from ..operators import portfolio as pt
from ..params import BENCHMARK, TEST_ROWS, StudyWindow
from .study import Study


class PortfolioStudy:
    def __init__(self, study: Study, universe_fn, test_rows: int = TEST_ROWS, benchmark: str = BENCHMARK,
                 store_universe: bool = False, goal: str | None = None):
        """``goal``: ``None``, the benchmark's mean training return as the target of every
        portfolio, or ``portfolio.NAIVE``, the mean of each portfolio's asset means."""
        self.study = study
        self._universe_fn = universe_fn
        self.store_universe = store_universe
        self.test_rows = test_rows
        self.benchmark = benchmark
        self.goal = goal

    @classmethod
    def fixed(cls, spark: SparkSession, sf_dir: str, window: StudyWindow, symbols,
              study: Study | None = None, **kw) -> "PortfolioStudy":
        return cls(study or Study(spark, sf_dir, window), lambda st: pt.fixed_universe(spark, symbols), **kw)

    @classmethod
    def sampled(cls, spark: SparkSession, sf_dir: str, window: StudyWindow, n_portfolios: int,
                n_assets: int, seed: int = 100, include_benchmark: bool = True,
                base: dict | None = None, study: Study | None = None, **kw) -> "PortfolioStudy":
        bench = kw.get("benchmark", BENCHMARK)

        def universe(st: Study) -> DataFrame:
            inc = (bench,) if include_benchmark else ()
            return pt.sampled_universe(st.eod_ret_stored.select("symbol"), n_portfolios, n_assets, seed, inc)
        return cls(study or Study(spark, sf_dir, window, base=base), universe, store_universe=True, **kw)

    def _shared(self, name: str, make):
        """A table that depends on the study only: written once for all portfolio studies on it."""
        kept = self.study.__dict__.setdefault("_portfolio_tables", {})
        if (name, self.test_rows) not in kept:
            kept[name, self.test_rows] = self.study.store(name, make())
        return kept[name, self.test_rows]

    @cached_property
    def universe(self) -> DataFrame:
        u = self._universe_fn(self.study)
        if self.store_universe:
            # the portfolio specification, written once: later steps read it
            # instead of re-running the draw
            u = self.study.store("universe", u)
        return u

    @cached_property
    def days(self) -> DataFrame:
        """(date, day, part): one row per date of the study."""
        return self._shared("days", lambda: pk.day_index(self.study.eod_ret_stored, self.test_rows))

    @cached_property
    def n_days(self) -> int:
        return self.days.count()

    @cached_property
    def n_train(self) -> int:
        return self.days.where("part = 'train'").count()

    @cached_property
    def split_ret(self) -> DataFrame:
        """The return grid with its day numbers, tagged train/test."""
        # one row per date: bounded by the calendar
        return self._shared("split_ret", lambda: self.study.eod_ret_stored.join(F.broadcast(self.days), "date"))

    @cached_property
    def packed(self) -> DataFrame:
        """One row per symbol: its returns as an array on the day index."""
        return self._shared("packed", lambda: pk.pack_series(self.split_ret, self.n_days))

    @cached_property
    def bench(self) -> DataFrame:
        return self.split_ret.where(F.col("symbol") == self.benchmark).select("date", "ret")

    @cached_property
    def returns(self) -> DataFrame:
        return pt.portfolio_returns(self.universe, self.study.eod_ret_stored)

    @cached_property
    def split(self) -> DataFrame:
        return pt.portfolio_returns(self.universe, self.split_ret,
                                    columns=("date", "ret", "part"))

    @cached_property
    def train(self) -> DataFrame:
        return self.split.where(F.col("part") == "train").drop("part")

    @cached_property
    def test(self) -> DataFrame:
        return self.split.where(F.col("part") == "test").drop("part")

    @cached_property
    def complete(self) -> DataFrame:
        """(portfolio_id, words): bitmap of the training days on which all assets have a return."""
        return pk.complete_days(self.universe, pk.day_bitmaps(self.split_ret.where("part = 'train'")))

    @cached_property
    def train_complete(self) -> DataFrame:
        return self.study.store("train_complete", pt.complete_rows(self.train))

    @cached_property
    def covariance(self) -> DataFrame:
        return pk.covariance_blocks(self.universe, self.packed, self.complete, self.n_days)

    @cached_property
    def bench_mean(self):
        """The benchmark's mean training return, a scalar column."""
        train = self.split_ret.where((F.col("symbol") == self.benchmark) & (F.col("part") == "train"))
        return train.agg(F.avg("ret")).scalar()

    @cached_property
    def target(self) -> DataFrame:
        if self.goal == pt.NAIVE:
            return pt.asset_means(self.train_complete).groupBy("portfolio_id").agg(F.avg("mean").alias("target"))
        return self.universe.select("portfolio_id").distinct().select("portfolio_id", self.bench_mean.alias("target"))

    def _solve(self, long_only: bool) -> DataFrame:
        return self.study.store("weights", pt.solve_weights(
            self.universe, self.packed, self.n_days, self.n_train, self.goal or self.bench_mean, long_only))

    @cached_property
    def weights(self) -> DataFrame:
        # solved once, read many times
        return self._solve(False)

    @cached_property
    def long_only_weights(self) -> DataFrame:
        return self._solve(True)

    @cached_property
    def portfolio_returns(self) -> DataFrame:
        return pt.apply_weights(self.weights, self.packed, self.days, self.n_days, self.n_train)

    @cached_property
    def rp(self) -> DataFrame:
        return pt.with_benchmark(self.portfolio_returns, self.bench, bench=self.benchmark)
