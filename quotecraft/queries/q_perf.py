"""Checked queries of the performance tables (long window, every kept series)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import performance as pf
from ..operators import returns as rt
from ..params import W_LONG
from ..plans.study import stored_study
from .registry import query, r_sql, rnd

T_TERMS = pf.T975_TERMS


def L(spark, d):
    return stored_study(spark, d, W_LONG)


def _t_sql(v: str) -> str:
    parts = [repr(pf.Z975)] + [f"{a!r} / power(CAST({v} AS DOUBLE), {k})" for k, a in enumerate(T_TERMS, 1)]
    return "(" + " + ".join(parts) + ")"


_SKEW = ("(avg(ret*ret*ret) - 3*avg(ret)*avg(ret*ret) + 2*power(avg(ret), 3)) / power(var_pop(ret), 1.5)")

STATS_SQL = f"""
SELECT symbol, observations, nas, minimum, {r_sql('quartile_1')} AS quartile_1, {r_sql('median')} AS median,
       {r_sql('arithmetic_mean')} AS arithmetic_mean,
       {r_sql('power(wealth, 1.0 / observations) - 1')} AS geometric_mean,
       {r_sql('quartile_3')} AS quartile_3, maximum, {r_sql('stdev / sqrt(observations)')} AS se_mean,
       {r_sql('arithmetic_mean - ' + _t_sql('observations - 1') + ' * stdev / sqrt(observations)')} AS lcl_mean,
       {r_sql('arithmetic_mean + ' + _t_sql('observations - 1') + ' * stdev / sqrt(observations)')} AS ucl_mean,
       {r_sql('variance')} AS variance, {r_sql('stdev')} AS stdev, {r_sql('skewness')} AS skewness,
       {r_sql('kurtosis')} AS kurtosis
FROM (SELECT symbol, count(ret) AS observations, count(*) - count(ret) AS nas, min(ret) AS minimum,
             quantile_cont(ret, 0.25) AS quartile_1, quantile_cont(ret, 0.5) AS median,
             avg(ret) AS arithmetic_mean, product(1.0 + ret) AS wealth, quantile_cont(ret, 0.75) AS quartile_3,
             max(ret) AS maximum, var_samp(ret) AS variance, stddev_samp(ret) AS stdev,
             {_SKEW} AS skewness, kurtosis_pop(ret) AS kurtosis
      FROM eod_ret_l GROUP BY symbol) s"""


@query("ret_04_stats_table", STATS_SQL)
def ret_04_stats_table(spark, d):
    return pf.stats_table(L(spark, d).eod_ret)


@query("ret_05_distributions_table", f"""
SELECT symbol, {r_sql('sd')} AS stdev, {r_sql('g1')} AS skewness, {r_sql('g2 + 3')} AS kurtosis,
       {r_sql('g2')} AS excess_kurtosis, {r_sql('g1 * sqrt(n * (n - 1)) / (n - 2)')} AS sample_skewness,
       {r_sql('(n - 1) * ((n + 1) * g2 + 6) / ((n - 2) * (n - 3))')} AS sample_excess_kurtosis
FROM (SELECT symbol, CAST(count(ret) AS DOUBLE) AS n, stddev_samp(ret) AS sd, {_SKEW} AS g1,
             kurtosis_pop(ret) AS g2 FROM eod_ret_l GROUP BY symbol) s""")
def ret_05_distributions_table(spark, d):
    return pf.distributions_table(L(spark, d).eod_ret)


ANN_SQL = f"""
SELECT symbol, {r_sql('ann_ret')} AS annualized_return, {r_sql('ann_sd')} AS annualized_std,
       {r_sql('ann_ret / ann_sd')} AS sharpe_ratio
FROM (SELECT symbol, power(product(1.0 + ret), 252.0 / count(ret)) - 1 AS ann_ret,
             stddev_samp(ret) * sqrt(252.0) AS ann_sd FROM eod_ret_l GROUP BY symbol) s"""


@query("ret_06_annualized_table", ANN_SQL)
def ret_06_annualized_table(spark, d):
    return pf.annualized_table(L(spark, d).eod_ret, 252)


@query("ret_07_cumulative_return", f"""
SELECT symbol, {r_sql('product(1.0 + ret) - 1')} AS cumulative_return FROM eod_ret_l GROUP BY symbol""")
def ret_07_cumulative_return(spark, d):
    return pf.cumulative_return(L(spark, d).eod_ret)


_CAPM_PAIRS = """(SELECT a.symbol, a.date, a.ret AS ra, b.ret AS rb FROM eod_ret_l a
  JOIN (SELECT date, ret FROM eod_ret_l WHERE symbol = 'SP500TR') b ON a.date = b.date
  WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL)"""


@query("ret_08_capm_table", f"""
SELECT symbol, n, {r_sql('alpha')} AS alpha, {r_sql('beta')} AS beta, {r_sql('beta_plus')} AS beta_plus,
       {r_sql('beta_minus')} AS beta_minus, {r_sql('r_squared')} AS r_squared,
       {r_sql('power(1.0 + alpha, 252.0) - 1')} AS annualized_alpha, {r_sql('correlation')} AS correlation,
       {r_sql('tracking_error')} AS tracking_error, {r_sql('ann_a - ann_b')} AS active_premium,
       {r_sql('ann_a / beta')} AS treynor_ratio,
       {r_sql('(ann_a - ann_b) / NULLIF(tracking_error, 0)')} AS information_ratio
FROM (SELECT symbol, count(*) AS n, regr_intercept(ra, rb) AS alpha, regr_slope(ra, rb) AS beta,
             regr_slope(CASE WHEN rb > 0 THEN ra END, CASE WHEN rb > 0 THEN rb END) AS beta_plus,
             regr_slope(CASE WHEN rb < 0 THEN ra END, CASE WHEN rb < 0 THEN rb END) AS beta_minus,
             regr_r2(ra, rb) AS r_squared, corr(ra, rb) AS correlation,
             stddev_samp(ra - rb) * sqrt(252.0) AS tracking_error,
             power(product(1.0 + ra), 252.0 / count(*)) - 1 AS ann_a,
             power(product(1.0 + rb), 252.0 / count(*)) - 1 AS ann_b
      FROM {_CAPM_PAIRS} p GROUP BY symbol) s""")
def ret_08_capm_table(spark, d):
    st = L(spark, d)
    return pf.capm_table(st.eod_ret, st.eod_ret.where(F.col("symbol") == "SP500TR"))


# Student's t for whole degrees of freedom v: each term of the finite sum by gamma
# functions, cos^2j * G(j + 1/2) / (G(j + 1) G(1/2)) for even v and
# cos^(2j + 1) * G(j + 1) G(3/2) / G(j + 3/2) for odd v
@query("ret_08_capm_p_value", f"""
WITH pairs AS (SELECT symbol, count(*) AS n, corr(ra, rb) AS r, count(*) - 2 AS v FROM {_CAPM_PAIRS} p GROUP BY symbol),
     angle AS (SELECT *, least(abs(r), 1.0) AS s, sqrt(1.0 - least(abs(r), 1.0) * least(abs(r), 1.0)) AS c FROM pairs),
     terms AS (SELECT symbol, unnest(generate_series(0, CAST(floor((v - 2 - v % 2) / 2.0) AS BIGINT))) AS j, v, c FROM angle),
     sums AS (SELECT symbol, sum(CASE WHEN v % 2 = 0
                THEN power(c, 2 * j) * exp(lgamma(j + 0.5) - lgamma(j + 1.0) - lgamma(0.5))
                ELSE power(c, 2 * j + 1) * exp(lgamma(j + 1.0) + lgamma(1.5) - lgamma(j + 1.5)) END) AS total
              FROM terms GROUP BY symbol)
SELECT symbol, n, {r_sql('r')} AS correlation,
       CASE WHEN v >= 1 AND r IS NOT NULL AND NOT isnan(r) THEN
         {r_sql("greatest(0.0, least(1.0, 1.0 - CASE WHEN v % 2 = 0 THEN s * coalesce(total, 0) ELSE (asin(s) + s * coalesce(total, 0)) * 2 / pi() END))", 8)}
       END AS correlation_p_value
FROM angle LEFT JOIN sums USING (symbol)""")
def ret_08_capm_p_value(spark, d):
    st = L(spark, d)
    capm = pf.capm_table(st.eod_ret, st.eod_ret.where(F.col("symbol") == "SP500TR"), places=None)
    out = pf.with_correlation_p_value(capm.select("symbol", "n", "correlation"))
    return out.select("symbol", "n", rnd("correlation").alias("correlation"),
                      rnd("correlation_p_value", 8).alias("correlation_p_value"))


_WEALTH = """(SELECT symbol, date, ret,
        coalesce(product(1.0 + ret) OVER (PARTITION BY symbol ORDER BY date
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0) AS wealth FROM eod_ret_l)"""


@query("ret_09_cumulative_series", f"""
SELECT symbol, date, {r_sql('wealth - 1', 8)} AS cumulative_return FROM {_WEALTH} w""")
def ret_09_cumulative_series(spark, d):
    return pf.cumulative_series(L(spark, d).eod_ret)


@query("win_04_running_product_max", f"""
SELECT symbol, date, ret, {r_sql('wealth', 8)} AS wealth,
       {r_sql('greatest(1.0, max(wealth) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))', 8)} AS peak
FROM {_WEALTH} w""")
def win_04_running_product_max(spark, d):
    x = pf.wealth_series(L(spark, d).eod_ret)
    return x.select("symbol", "date", "ret", rnd("wealth", 8).alias("wealth"), rnd("peak", 8).alias("peak"))


@query("ret_10_drawdown_series", f"""
SELECT symbol, date,
       {r_sql('wealth / greatest(1.0, max(wealth) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1', 8)} AS drawdown
FROM {_WEALTH} w""")
def ret_10_drawdown_series(spark, d):
    return pf.drawdown_series(L(spark, d).eod_ret)


_RANKED = """(SELECT symbol, date, ret, row_number() OVER (PARTITION BY symbol ORDER BY ret) AS rn,
                    count(*) OVER (PARTITION BY symbol) AS n FROM eod_ret_l WHERE ret IS NOT NULL)"""


def _hinge_sql(d: str) -> str:
    return (f"0.5 * (max(CASE WHEN rn = floor({d}) THEN ret END) + max(CASE WHEN rn = ceil({d}) THEN ret END))")


_N4 = "(floor((n + 3) / 2.0) / 2.0)"
_FIVE = f"""(SELECT symbol, max(n) AS n, avg(ret) AS mean, {_hinge_sql(_N4)} AS lh,
                    {_hinge_sql('(n + 1) / 2.0')} AS med, {_hinge_sql('n + 1 - ' + _N4)} AS uh
             FROM {_RANKED} r GROUP BY symbol)"""


@query("ret_11_boxplot_stats", f"""
SELECT f.symbol, f.n, min(CASE WHEN e.ret >= lo AND e.ret <= hi THEN e.ret END) AS lower_whisker,
       {r_sql('f.lh')} AS lower_hinge, {r_sql('f.med')} AS median, {r_sql('f.uh')} AS upper_hinge,
       max(CASE WHEN e.ret >= lo AND e.ret <= hi THEN e.ret END) AS upper_whisker,
       count(CASE WHEN e.ret < lo OR e.ret > hi THEN 1 END) AS n_outliers, {r_sql('f.mean')} AS mean
FROM (SELECT *, lh - 1.5 * (uh - lh) AS lo, uh + 1.5 * (uh - lh) AS hi FROM {_FIVE} x) f
JOIN eod_ret_l e ON e.symbol = f.symbol AND e.ret IS NOT NULL
GROUP BY f.symbol, f.n, f.lh, f.med, f.uh, f.mean""")
def ret_11_boxplot_stats(spark, d):
    return pf.boxplot_stats(L(spark, d).eod_ret)


@query("ret_11_boxplot_outliers", f"""
SELECT e.symbol, e.date, e.ret
FROM (SELECT *, lh - 1.5 * (uh - lh) AS lo, uh + 1.5 * (uh - lh) AS hi FROM {_FIVE} x) f
JOIN eod_ret_l e ON e.symbol = f.symbol AND e.ret IS NOT NULL WHERE e.ret < lo OR e.ret > hi""")
def ret_11_boxplot_outliers(spark, d):
    return pf.boxplot_outliers(L(spark, d).eod_ret)


@query("agg_19_series_mean", f"""
SELECT symbol, {r_sql('avg(ret)')} AS mean_ret FROM eod_ret_l GROUP BY symbol""")
def agg_19_series_mean(spark, d):
    return agg.series_mean(L(spark, d).eod_ret, keys=["symbol"]).select("symbol", rnd("mean_ret").alias("mean_ret"))


@query("agg_17_column_max_long", "SELECT * FROM gmax_l")
def agg_17_column_max_long(spark, d):
    return rt.column_max(L(spark, d).grid_ret)


@query("ret_06_annualized_inferred_scale", f"""
SELECT symbol, {r_sql('ann_ret')} AS annualized_return, {r_sql('ann_sd')} AS annualized_std,
       {r_sql('ann_ret / ann_sd')} AS sharpe_ratio
FROM (SELECT r.symbol, power(product(1.0 + r.ret), CAST(f.scale AS DOUBLE) / count(r.ret)) - 1 AS ann_ret,
             stddev_samp(r.ret) * sqrt(CAST(f.scale AS DOUBLE)) AS ann_sd
      FROM eod_ret_lm r JOIN (
        SELECT symbol, CASE WHEN m <= 3.5 THEN 252 WHEN m <= 10 THEN 52 WHEN m <= 45 THEN 12
                            WHEN m <= 135 THEN 4 ELSE 1 END AS scale
        FROM (SELECT symbol, quantile_cont(gap, 0.5) AS m
              FROM (SELECT symbol, date_diff('day', lag(date) OVER (PARTITION BY symbol ORDER BY date), date) AS gap
                    FROM eod_ret_lm) g GROUP BY symbol) x) f ON f.symbol = r.symbol
      GROUP BY r.symbol, f.scale) s""")
def ret_06_annualized_inferred_scale(spark, d):
    return pf.annualized_table(L(spark, d).eom_ret, scale=None)


@query("ret_06_periods_per_year", """
SELECT symbol, CASE WHEN m <= 3.5 THEN 252 WHEN m <= 10 THEN 52 WHEN m <= 45 THEN 12
                    WHEN m <= 135 THEN 4 ELSE 1 END AS scale
FROM (SELECT symbol, quantile_cont(gap, 0.5) AS m
      FROM (SELECT symbol, date_diff('day', lag(date) OVER (PARTITION BY symbol ORDER BY date), date) AS gap
            FROM eod_ret_l) g GROUP BY symbol) x""")
def ret_06_periods_per_year(spark, d):
    return pf.periods_per_year(L(spark, d).eod_ret)
