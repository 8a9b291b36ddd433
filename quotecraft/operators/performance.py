"""Performance tables over long return series: RET-04..11, AGG-19, WIN-04.

Input is (symbol, date, ret) with NULL for a missing return; every table is
one grouped aggregation per symbol (plus a benchmark join for CAPM), so a
thousand series cost the same plan as one.  Per-symbol windows (cumulative
return, drawdown, box-plot ranks) hold at most one row per trading day.

The formulas follow the textbook definitions the R package functions are
documented with; they are this library's definitions:

- quantiles: linear interpolation between order statistics (R type 7)
- skewness: population moment ratio m3 / m2^1.5; kurtosis: m4 / m2^2,
  excess = kurtosis - 3; sample versions with the usual n-corrections
- geometric mean: (prod(1 + r))^(1/n) - 1; annualised return:
  (prod(1 + r))^(scale/n) - 1; annualised stdev: sd * sqrt(scale)
- CAPM: OLS of asset on benchmark over dates where both are present
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import SCALE_DAILY

# --- fixed values: two-sided 95 % normal quantile and the Cornish-Fisher
# expansion of Student's t quantile in 1/v (four terms) ------------------------
Z975 = 1.959963984540054
T_SERIES = (
    (1, 1, 0, 0, 0, 4),                 # (z^3 + z) / 4
    (5, 16, 3, 0, 0, 96),               # (5z^5 + 16z^3 + 3z) / 96
    (3, 19, 17, -15, 0, 384),           # (3z^7 + 19z^5 + 17z^3 - 15z) / 384
    (79, 776, 1482, -1920, -945, 92160),  # (79z^9 + 776z^7 + 1482z^5 - 1920z^3 - 945z) / 92160
)


def _t_terms(z: float) -> list[float]:
    out = []
    for k, coefs in enumerate(T_SERIES, start=1):
        *cs, den = coefs
        powers = [2 * k + 1 - 2 * i for i in range(len(cs))]
        out.append(sum(c * z ** p for c, p in zip(cs, powers)) / den)
    return out


T975_TERMS = _t_terms(Z975)


def t_quantile_975(v: Column) -> Column:
    """Student's t 97.5 % quantile for ``v`` degrees of freedom (Column).

    Accurate to 1e-5 from v = 10 on (2.22814 at 10, 2.04227 at 30, 1.98397 at
    100); coarse below v = 5.
    """
    v = v.cast("double")
    expr = F.lit(Z975)
    for k, a in enumerate(T975_TERMS, start=1):
        expr = expr + F.try_divide(F.lit(a), F.pow(v, k))
    return F.when(v >= 1, expr)


def _r6(c: Column, k: int | None) -> Column:
    return c if k is None else F.round(c, k) + F.lit(0.0)


def stats_table(ret: DataFrame, key: str = "symbol", value: str = "ret", places: int | None = 6) -> DataFrame:
    """RET-04: the statistics table, one row per series."""
    r = F.col(value)
    g = ret.groupBy(key).agg(
        F.count(r).alias("observations"), (F.count(F.lit(1)) - F.count(r)).alias("nas"),
        F.min(r).alias("minimum"), F.percentile(r, 0.25).alias("quartile_1"),
        F.percentile(r, 0.5).alias("median"), F.avg(r).alias("arithmetic_mean"),
        F.product(F.lit(1.0) + r).alias("_wealth"), F.percentile(r, 0.75).alias("quartile_3"),
        F.max(r).alias("maximum"), F.var_samp(r).alias("variance"), F.stddev_samp(r).alias("stdev"),
        F.skewness(r).alias("skewness"), F.kurtosis(r).alias("kurtosis"))
    n = F.col("observations")
    se = F.try_divide(F.col("stdev"), F.sqrt(n))
    t = t_quantile_975(n - 1)
    out = g.select(
        key, "observations", "nas", "minimum", "quartile_1", "median", "arithmetic_mean",
        (F.pow(F.col("_wealth"), F.try_divide(F.lit(1.0), n)) - 1).alias("geometric_mean"),
        "quartile_3", "maximum", se.alias("se_mean"),
        (F.col("arithmetic_mean") - t * se).alias("lcl_mean"),
        (F.col("arithmetic_mean") + t * se).alias("ucl_mean"),
        "variance", "stdev", "skewness", "kurtosis")
    keep = {key, "observations", "nas", "minimum", "maximum"}
    return out.select(*[F.col(c) if c in keep else _r6(F.col(c), places).alias(c) for c in out.columns])


def distributions_table(ret: DataFrame, key: str = "symbol", value: str = "ret",
                        places: int | None = 6) -> DataFrame:
    """RET-05: stdev, skewness, kurtosis, excess kurtosis, sample skewness and
    sample excess kurtosis per series."""
    r = F.col(value)
    g = ret.groupBy(key).agg(F.count(r).alias("_n"), F.stddev_samp(r).alias("stdev"),
                             F.skewness(r).alias("skewness"), F.kurtosis(r).alias("_g2"))
    n = F.col("_n").cast("double")
    out = g.select(
        key, "stdev", "skewness", (F.col("_g2") + 3).alias("kurtosis"), F.col("_g2").alias("excess_kurtosis"),
        F.try_divide(F.col("skewness") * F.sqrt(n * (n - 1)), n - 2).alias("sample_skewness"),
        F.try_divide((n - 1) * ((n + 1) * F.col("_g2") + 6), (n - 2) * (n - 3)).alias("sample_excess_kurtosis"))
    return out.select(key, *[_r6(F.col(c), places).alias(c) for c in out.columns if c != key])


# periods per year by the median spacing of a series, in days (fixed values:
# daily 252, weekly 52, monthly 12, quarterly 4, else yearly 1)
FREQUENCIES = ((3.5, 252), (10.0, 52), (45.0, 12), (135.0, 4))


def periods_per_year(ret: DataFrame, key: str | list[str] = "symbol") -> DataFrame:
    """(key, scale): periods per year inferred from the median gap in days
    between consecutive dates of each series (one window per series, bounded
    by the calendar; exact median)."""
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy("date")
    gaps = ret.select(*keys, F.datediff("date", F.lag("date").over(w)).alias("_gap"))
    med = gaps.groupBy(*keys).agg(F.percentile("_gap", 0.5).alias("_m"))
    scale = F.lit(1)
    for limit, periods in reversed(FREQUENCIES):
        scale = F.when(F.col("_m") <= limit, F.lit(periods)).otherwise(scale)
    return med.select(*keys, scale.alias("scale"))


def annualized_table(ret: DataFrame, scale: int | None = SCALE_DAILY, key: str = "symbol", value: str = "ret",
                     places: int | None = 6) -> DataFrame:
    """RET-06: annualised return, annualised stdev and Sharpe ratio (Rf = 0).

    ``scale=None`` infers each series' periods per year from its dates
    (:func:`periods_per_year`), as the R function does without ``scale``.
    """
    keys = [key] if isinstance(key, str) else list(key)
    r = F.col(value)
    g = ret.groupBy(*keys).agg(F.count(r).alias("_n"), F.product(F.lit(1.0) + r).alias("_w"),
                               F.stddev_samp(r).alias("_sd"))
    if scale is None:
        g = g.join(periods_per_year(ret, keys), keys)
        s = F.col("scale").cast("double")
    else:
        s = F.lit(float(scale))
    ann = F.pow(F.col("_w"), F.try_divide(s, F.col("_n"))) - 1
    sd = F.col("_sd") * F.sqrt(s)
    out = g.select(*keys, ann.alias("annualized_return"), sd.alias("annualized_std"))
    out = out.withColumn("sharpe_ratio", F.try_divide(F.col("annualized_return"), F.col("annualized_std")))
    return out.select(*keys, *[_r6(F.col(c), places).alias(c) for c in out.columns if c not in keys])


def cumulative_return(ret: DataFrame, key: str = "symbol", value: str = "ret",
                      places: int | None = 6) -> DataFrame:
    """RET-07: ``prod(1 + r) - 1`` over each whole series."""
    out = ret.groupBy(key).agg((F.product(F.lit(1.0) + F.col(value)) - 1).alias("cumulative_return"))
    return out.select(key, _r6(F.col("cumulative_return"), places).alias("cumulative_return"))


def wealth_series(ret: DataFrame, key: str | list[str] = "symbol", value: str = "ret") -> DataFrame:
    """WIN-04: running product of (1 + r) and its running maximum, per series.

    A missing return leaves wealth unchanged; wealth starts at 1.
    """
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    wealth = F.coalesce(F.product(F.lit(1.0) + F.col(value)).over(w), F.lit(1.0))
    x = ret.select(*keys, "date", value, wealth.alias("wealth"))
    return x.withColumn("peak", F.greatest(F.lit(1.0), F.max("wealth").over(w)))


def cumulative_series(ret: DataFrame, key: str = "symbol", value: str = "ret",
                      places: int | None = 8) -> DataFrame:
    """RET-09: cumulative return at every date (the cumulative-returns chart data)."""
    keys = [key] if isinstance(key, str) else list(key)
    x = wealth_series(ret, keys, value)
    return x.select(*keys, "date", _r6(F.col("wealth") - 1, places).alias("cumulative_return"))


def drawdown_series(ret: DataFrame, key: str = "symbol", value: str = "ret",
                    places: int | None = 8) -> DataFrame:
    """RET-10: drawdown = wealth / max(1, running peak) - 1 (the drawdown chart data)."""
    x = wealth_series(ret, key, value)
    return x.select(key, "date", _r6(F.col("wealth") / F.col("peak") - 1, places).alias("drawdown"))


def _fivenum_positions(n: Column) -> list[Column]:
    n4 = F.floor((n + 3) / 2) / 2
    return [F.lit(1.0), n4, (n + 1) / 2, n + 1 - n4, n.cast("double")]


def boxplot_stats(ret: DataFrame, key: str = "symbol", value: str = "ret", coef: float = 1.5,
                  places: int | None = 6) -> DataFrame:
    """RET-11: box-plot figures per series: Tukey hinges (``fivenum``),
    whiskers at ``coef`` x IQR, outlier count and mean."""
    x = ret.where(F.col(value).isNotNull())
    w = Window.partitionBy(key).orderBy(value)
    ranked = x.select(key, value, F.row_number().over(w).alias("_rn"),
                      F.count(F.lit(1)).over(Window.partitionBy(key)).alias("_n"))
    n = F.col("_n")
    aggs = []
    for name, d in zip(("_s1", "lower_hinge", "median", "upper_hinge", "_s5"), _fivenum_positions(n)):
        lo = F.max(F.when(F.col("_rn") == F.floor(d), F.col(value)))
        hi = F.max(F.when(F.col("_rn") == F.ceil(d), F.col(value)))
        aggs.append((F.lit(0.5) * (lo + hi)).alias(name))
    five = ranked.groupBy(key).agg(F.first("_n").alias("n"), F.avg(value).alias("mean"), *aggs)
    iqr = F.col("upper_hinge") - F.col("lower_hinge")
    five = five.withColumn("_lo", F.col("lower_hinge") - F.lit(coef) * iqr) \
               .withColumn("_hi", F.col("upper_hinge") + F.lit(coef) * iqr)
    v = F.col(value)
    inside = (v >= F.col("_lo")) & (v <= F.col("_hi"))
    whisk = x.join(five.select(key, "_lo", "_hi"), key).groupBy(key).agg(
        F.min(F.when(inside, v)).alias("lower_whisker"), F.max(F.when(inside, v)).alias("upper_whisker"),
        F.count(F.when(~inside, 1)).alias("n_outliers"))
    out = five.join(whisk, key).select(key, "n", "lower_whisker", "lower_hinge", "median", "upper_hinge",
                                       "upper_whisker", "n_outliers", "mean")
    return out.select(key, "n", "lower_whisker", _r6(F.col("lower_hinge"), places).alias("lower_hinge"),
                      _r6(F.col("median"), places).alias("median"),
                      _r6(F.col("upper_hinge"), places).alias("upper_hinge"), "upper_whisker", "n_outliers",
                      _r6(F.col("mean"), places).alias("mean"))


def boxplot_outliers(ret: DataFrame, key: str = "symbol", value: str = "ret", coef: float = 1.5) -> DataFrame:
    """RET-11: the outlier rows (symbol, date, ret) beyond the whiskers' limits."""
    x = ret.where(F.col(value).isNotNull())
    w = Window.partitionBy(key).orderBy(value)
    ranked = x.select(key, value, F.row_number().over(w).alias("_rn"),
                      F.count(F.lit(1)).over(Window.partitionBy(key)).alias("_n"))
    n = F.col("_n")
    _, n4, _, n4u, _ = _fivenum_positions(n)
    h = []
    for name, d in (("_lh", n4), ("_uh", n4u)):
        lo = F.max(F.when(F.col("_rn") == F.floor(d), F.col(value)))
        hi = F.max(F.when(F.col("_rn") == F.ceil(d), F.col(value)))
        h.append((F.lit(0.5) * (lo + hi)).alias(name))
    hinges = ranked.groupBy(key).agg(*h)
    iqr = F.col("_uh") - F.col("_lh")
    lim = hinges.select(key, (F.col("_lh") - F.lit(coef) * iqr).alias("_lo"),
                        (F.col("_uh") + F.lit(coef) * iqr).alias("_hi"))
    v = F.col(value)
    return x.join(lim, key).where((v < F.col("_lo")) | (v > F.col("_hi"))).select(key, "date", value)


def capm_table(assets: DataFrame, bench: DataFrame, scale: int = SCALE_DAILY, key: str = "symbol",
               value: str = "ret", places: int | None = 6) -> DataFrame:
    """RET-08: the CAPM table per asset against one benchmark series.

    Pairs are the dates where both returns are present.  Alpha/beta are OLS
    (``regr_intercept`` / ``regr_slope``); beta+/beta- use only dates with a
    positive/negative benchmark return.
    """
    # one benchmark row per date: bounded by the calendar, so broadcast
    b = F.broadcast(bench.select("date", F.col(value).alias("_rb")))
    j = assets.select(key, "date", F.col(value).alias("_ra")).join(b, "date") \
        .where(F.col("_ra").isNotNull() & F.col("_rb").isNotNull())
    ra, rb = F.col("_ra"), F.col("_rb")
    up, dn = rb > 0, rb < 0
    g = j.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_intercept(ra, rb).alias("alpha"), F.regr_slope(ra, rb).alias("beta"),
        F.regr_slope(F.when(up, ra), F.when(up, rb)).alias("beta_plus"),
        F.regr_slope(F.when(dn, ra), F.when(dn, rb)).alias("beta_minus"),
        F.regr_r2(ra, rb).alias("r_squared"), F.corr(ra, rb).alias("correlation"),
        (F.stddev_samp(ra - rb) * F.sqrt(F.lit(float(scale)))).alias("tracking_error"),
        F.product(F.lit(1.0) + ra).alias("_wa"), F.product(F.lit(1.0) + rb).alias("_wb"))
    s = F.lit(float(scale))
    ann_a = F.pow(F.col("_wa"), s / F.col("n")) - 1
    ann_b = F.pow(F.col("_wb"), s / F.col("n")) - 1
    out = g.select(key, "n", "alpha", "beta", "beta_plus", "beta_minus", "r_squared",
                   (F.pow(F.lit(1.0) + F.col("alpha"), s) - 1).alias("annualized_alpha"),
                   "correlation", "tracking_error", (ann_a - ann_b).alias("active_premium"),
                   F.try_divide(ann_a, F.col("beta")).alias("treynor_ratio"))
    out = out.withColumn("information_ratio", F.try_divide(F.col("active_premium"),
                                                           F.nullif(F.col("tracking_error"), F.lit(0.0))))
    return out.select(key, "n", *[_r6(F.col(c), places).alias(c) for c in out.columns if c not in (key, "n")])


# --- correlation p-value: Student's t for whole degrees of freedom ------------------

def correlation_p_value(r: Column, n: Column) -> Column:
    """Two-sided p-value of Pearson's ``r`` over ``n`` pairs (t test, n - 2 df).

    For whole degrees of freedom the t distribution is a finite trigonometric
    sum: with sin(theta) = |r| the terms are powers of cos(theta)^2 times
    ratios of odd and even numbers.  NULL for fewer than 3 pairs or no ``r``.
    The value is one minus the sum, so it is good to about 1e-12 absolute.
    """
    df = (n - 2).cast("int")
    s = F.least(F.abs(r), F.lit(1.0))
    cos2 = F.lit(1.0) - s * s
    odd = df % 2 == 1
    last = F.floor((df - F.when(odd, 3).otherwise(2)) / 2).cast("int")
    # at most half the trading days of the window
    steps = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))

    def add(acc: Column, j: Column) -> Column:
        ratio = F.when(odd, (2.0 * j) / (2.0 * j + 1)).otherwise((2.0 * j - 1) / (2.0 * j))
        term = acc["term"] * cos2 * ratio
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    first = F.when(~odd, 1.0).when(df >= 3, F.sqrt(cos2)).otherwise(0.0)
    total = F.aggregate(steps, F.struct(first.alias("term"), first.alias("total")), add, lambda acc: acc["total"])
    inside = F.when(odd, F.lit(2.0 / math.pi) * (F.asin(s) + s * total)).otherwise(s * total)
    return F.when((df >= 1) & r.isNotNull() & ~F.isnan(r),
                  F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - inside)))


def with_correlation_p_value(capm: DataFrame) -> DataFrame:
    """RET-08 p-value column of a CAPM table (one row per asset)."""
    return capm.withColumn("correlation_p_value", correlation_p_value(F.col("correlation"), F.col("n")))
