"""Checked queries of the portfolio study (long window).

Small cases have closed forms in SQL: one 3-asset portfolio (L1, L2, L3), and
drawn 3-asset portfolios without short positions.  The many drawn portfolios are
checked against an elimination written out in SQL, one step a table; DuckDB repeats
the draw, since it needs only md5.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import performance as pf
from ..operators import packed as pk
from ..operators import portfolio as pt
from ..params import BENCHMARK, LONG_ASSETS, TEST_ROWS, W_LONG
from ..plans.portfolio_study import PortfolioStudy
from ..plans.study import stored_study
from .registry import query, r_sig_sql, r_sql, rnd, rnd_many, rnd_sig

A1, A2, A3 = LONG_ASSETS


def P(spark, d) -> PortfolioStudy:
    return PortfolioStudy.fixed(spark, d, W_LONG, LONG_ASSETS, study=stored_study(spark, d, W_LONG))


# --- oracle texts of portfolios ----------------------------------------------------------------

def draw_ctes(tag: str, n_portfolios: int, k: int, seed: int, pool: str, include: tuple[str, ...] = ()) -> dict[str, str]:
    """``{tag}_universe`` (portfolio_id, symbol): Floyd's draw, one table a step."""
    out = {f"{tag}_pool": f"SELECT symbol, row_number() OVER (ORDER BY md5(symbol), symbol) AS idx FROM ({pool}) p",
           f"{tag}_draw0": f"SELECT p AS portfolio_id, (SELECT count(*) FROM {tag}_pool) AS n FROM range({n_portfolios}) r(p)"}
    for i in range(1, k + 1):
        j = f"(n - {k - i})"
        t = f"(1 + CAST('0x' || substr(md5('{seed},' || portfolio_id || ',' || {j}), 1, 15) AS BIGINT) % {j})"
        taken = " OR ".join(f"{t} = c{x}" for x in range(1, i)) or "FALSE"
        out[f"{tag}_draw{i}"] = f"SELECT *, CASE WHEN {taken} THEN {j} ELSE {t} END AS c{i} FROM {tag}_draw{i - 1}"
    picks = " UNION ALL ".join(f"SELECT portfolio_id, c{i} AS idx FROM {tag}_draw{k}" for i in range(1, k + 1))
    extra = "".join(f" UNION ALL SELECT portfolio_id, '{x}' FROM {tag}_draw0" for x in include)
    out[f"{tag}_universe"] = f"SELECT portfolio_id, symbol FROM ({picks}) d JOIN {tag}_pool USING (idx){extra}"
    return out


def drawn_rows_ctes(tag: str, n: int) -> dict[str, str]:
    """Training and test rows of ``{tag}_universe``, its complete training rows (``n`` assets each)."""
    return {
        f"{tag}_rows": f"SELECT portfolio_id, symbol, date, ret FROM {tag}_universe JOIN eod_ret_l USING (symbol)",
        f"{tag}_train": f"SELECT * FROM {tag}_rows ANTI JOIN test_dates_l USING (date)",
        f"{tag}_test": f"SELECT * FROM {tag}_rows SEMI JOIN test_dates_l USING (date)",
        f"{tag}_full": f"SELECT portfolio_id, date FROM {tag}_train GROUP BY ALL HAVING count(ret) = {n}",
        f"{tag}_complete": f"SELECT * FROM {tag}_train SEMI JOIN {tag}_full USING (portfolio_id, date)",
    }


def weights_ctes(tag: str, n: int, target: str) -> dict[str, str]:
    """``{tag}_weights``: the bordered system of ``n`` assets by elimination without
    exchanges (its leading block is a covariance, so no pivot is zero)."""
    size = n + 2
    cov = "max(CASE WHEN i = {i} AND j = {j} THEN cov END)"
    mean = "max(CASE WHEN i = {i} AND j = {i} THEN mu END)"

    def entry(i: int, j: int) -> str:
        if i > j and j < size:
            i, j = j, i
        if j == size:
            return {n: "1.0", n + 1: f"max({target})"}.get(i, "0.0")
        if i >= n:
            return "0.0"
        return cov.format(i=i, j=j) if j < n else "1.0" if j == n else mean.format(i=i)

    cols = [(i, j) for i in range(size) for j in range(size + 1)]
    out = {
        f"{tag}_asset": f"""
SELECT portfolio_id, symbol, row_number() OVER (PARTITION BY portfolio_id ORDER BY symbol) - 1 AS i, avg(ret) AS mu
FROM {tag}_complete GROUP BY portfolio_id, symbol""",
        f"{tag}_cov": f"""
SELECT a.portfolio_id, a.symbol AS asset_a, b.symbol AS asset_b, covar_samp(a.ret, b.ret) AS cov
FROM {tag}_complete a JOIN {tag}_complete b USING (portfolio_id, date) GROUP BY ALL""",
        f"{tag}_mom": f"""
SELECT c.portfolio_id, x.i, y.i AS j, x.mu, c.cov FROM {tag}_cov c
JOIN {tag}_asset x ON x.portfolio_id = c.portfolio_id AND x.symbol = c.asset_a
JOIN {tag}_asset y ON y.portfolio_id = c.portfolio_id AND y.symbol = c.asset_b""",
        f"{tag}_step0": f"SELECT portfolio_id, {', '.join(f'{entry(i, j)} AS a{i}_{j}' for i, j in cols)} FROM {tag}_mom GROUP BY portfolio_id",
    }
    for k in range(size):
        step = ", ".join(f"a{i}_{j}" if i == k or j <= k else f"a{i}_{j} - a{i}_{k} / a{k}_{k} * a{k}_{j} AS a{i}_{j}"
                         for i, j in cols if j > k or j == i)
        out[f"{tag}_step{k + 1}"] = f"SELECT portfolio_id, {step} FROM {tag}_step{k}"
        cols = [(i, j) for i, j in cols if j > k or j == i]
    picks = " ".join(f"WHEN {i} THEN a{i}_{size} / a{i}_{i}" for i in range(n))
    out[f"{tag}_weights"] = f"""
SELECT s.portfolio_id, a.symbol, CASE a.i {picks} END AS weight FROM {tag}_step{size} s JOIN {tag}_asset a USING (portfolio_id)"""
    return out


def clamped_ctes(tag: str, complete: str, target: str) -> dict[str, str]:
    """``{tag}_clamped``: three assets without short positions.  By rising mean, the weights are a line
    in the middle one's; its best point is clamped to where no weight is negative."""
    return {
        f"{tag}_by_mean": f"""
SELECT portfolio_id, symbol, row_number() OVER (PARTITION BY portfolio_id ORDER BY avg(ret), symbol) AS k, avg(ret) AS mu
FROM {complete} GROUP BY portfolio_id, symbol""",
        f"{tag}_three": f"""
SELECT portfolio_id, date, max(CASE WHEN k = 1 THEN ret END) AS r1, max(CASE WHEN k = 2 THEN ret END) AS r2,
       max(CASE WHEN k = 3 THEN ret END) AS r3 FROM {complete} JOIN {tag}_by_mean USING (portfolio_id, symbol) GROUP BY portfolio_id, date""",
        f"{tag}_line": f"""
SELECT portfolio_id, m1, m2, m3, t, t BETWEEN m1 - 1e-12 AND m3 + 1e-12 AS able, (m3 - t) / (m3 - m1) AS u, (m3 - m2) / (m3 - m1) AS v,
       s11, s12, s13, s22, s23, s33
FROM (SELECT portfolio_id, avg(r1) AS m1, avg(r2) AS m2, avg(r3) AS m3, covar_samp(r1, r1) AS s11, covar_samp(r1, r2) AS s12,
             covar_samp(r1, r3) AS s13, covar_samp(r2, r2) AS s22, covar_samp(r2, r3) AS s23, covar_samp(r3, r3) AS s33,
             {target} AS t FROM {tag}_three GROUP BY portfolio_id) moments""",
        # weights: (u - v x, x, 1 - u - (1 - v) x)
        f"{tag}_best": f"""
SELECT *, greatest(0, least(u / nullif(v, 0), (1 - u) / nullif(1 - v, 0),
    (v * (u * s11 + (1 - u) * s13) - (u * s12 + (1 - u) * s23) + (1 - v) * (u * s13 + (1 - u) * s33))
    / (v * v * s11 + s22 + (1 - v) * (1 - v) * s33 - 2 * v * s12 + 2 * v * (1 - v) * s13 - 2 * (1 - v) * s23))) AS x
FROM {tag}_line""",
        f"{tag}_clamped": f"""
SELECT b.portfolio_id, symbol, able, CASE k WHEN 1 THEN u - v * x WHEN 2 THEN x ELSE 1 - u - (1 - v) * x END AS weight
FROM {tag}_best b JOIN {tag}_by_mean USING (portfolio_id)""",
    }


_CTES = {
    "ret_dates_l": "SELECT DISTINCT date FROM eod_ret_l",
    "test_dates_l": f"""
SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date DESC) AS rn FROM ret_dates_l) x
WHERE rn <= {TEST_ROWS}""",
    "ptf_rows": f"""
SELECT CAST(0 AS BIGINT) AS portfolio_id, symbol, date, ret FROM eod_ret_l WHERE symbol IN ('{A1}', '{A2}', '{A3}')""",
    "ptf_train": "SELECT * FROM ptf_rows WHERE date NOT IN (SELECT date FROM test_dates_l)",
    "ptf_test": "SELECT * FROM ptf_rows WHERE date IN (SELECT date FROM test_dates_l)",
    "ptf_complete": """
SELECT * FROM ptf_train WHERE date IN (SELECT date FROM ptf_train GROUP BY date HAVING count(ret) = 3)""",
    "ptf_wide": f"""
SELECT date, max(CASE WHEN symbol = '{A1}' THEN ret END) AS r1, max(CASE WHEN symbol = '{A2}' THEN ret END) AS r2,
       max(CASE WHEN symbol = '{A3}' THEN ret END) AS r3 FROM ptf_complete GROUP BY date""",
    "ptf_target": f"""
SELECT CAST(0 AS BIGINT) AS portfolio_id, avg(ret) AS target FROM eod_ret_l
WHERE symbol = '{BENCHMARK}' AND date NOT IN (SELECT date FROM test_dates_l)""",
    "ptf_mom": """
SELECT avg(r1) AS m1, avg(r2) AS m2, avg(r3) AS m3, covar_samp(r1, r1) AS s11, covar_samp(r1, r2) AS s12,
       covar_samp(r1, r3) AS s13, covar_samp(r2, r2) AS s22, covar_samp(r2, r3) AS s23, covar_samp(r3, r3) AS s33,
       (SELECT target FROM ptf_target) AS t FROM ptf_wide""",
    "ptf_w0": """
SELECT *, m3 - m2 AS d1, m1 - m3 AS d2, m2 - m1 AS d3, (t - m2) / (m1 - m2) AS u FROM ptf_mom""",
    "ptf_c": """
SELECT *, (d1 * (s11 * u + s12 * (1 - u)) + d2 * (s12 * u + s22 * (1 - u)) + d3 * (s13 * u + s23 * (1 - u)))
          / (d1 * (s11 * d1 + s12 * d2 + s13 * d3) + d2 * (s12 * d1 + s22 * d2 + s23 * d3)
             + d3 * (s13 * d1 + s23 * d2 + s33 * d3)) AS c FROM ptf_w0""",
    "ptf_weights": f"""
SELECT CAST(0 AS BIGINT) AS portfolio_id, '{A1}' AS symbol, u - c * d1 AS weight FROM ptf_c
UNION ALL SELECT 0, '{A2}', (1 - u) - c * d2 FROM ptf_c
UNION ALL SELECT 0, '{A3}', 0 - c * d3 FROM ptf_c""",
    "ptf_port_ret": """
SELECT t.portfolio_id, t.date, CASE WHEN count(t.ret) = 3 THEN sum(w.weight * t.ret) END AS ret
FROM ptf_test t JOIN ptf_weights w ON w.symbol = t.symbol GROUP BY t.portfolio_id, t.date""",
    "ptf_rp": f"""
SELECT portfolio_id, 'ptf' AS series, date, ret FROM ptf_port_ret
UNION ALL
SELECT p.portfolio_id, '{BENCHMARK}', p.date, b.ret FROM ptf_port_ret p
JOIN eod_ret_l b ON b.date = p.date AND b.symbol = '{BENCHMARK}'""",
}


@query("ptf_01_universe", f"""
SELECT CAST(0 AS BIGINT) AS portfolio_id, symbol, count(ret) AS n_obs FROM eod_ret_l
WHERE symbol IN ('{A1}', '{A2}', '{A3}') GROUP BY symbol""")
def ptf_01_universe(spark, d):
    p = P(spark, d)
    return p.returns.groupBy("portfolio_id", "symbol").agg(F.count("ret").alias("n_obs"))


@query("ts_10_fixed_assets", f"""
SELECT CAST(0 AS BIGINT) AS portfolio_id, symbol, date, ret FROM eod_ret_l
WHERE symbol IN ('{A1}', '{A2}', '{A3}')""")
def ts_10_fixed_assets(spark, d):
    return P(spark, d).returns.select("portfolio_id", "symbol", "date", "ret")


@query("ptf_02_train_test_split", """
SELECT portfolio_id, symbol, date, ret, 'train' AS part FROM ptf_train
UNION ALL SELECT portfolio_id, symbol, date, ret, 'test' FROM ptf_test""", _CTES)
def ptf_02_train_test_split(spark, d):
    return P(spark, d).split.select("portfolio_id", "symbol", "date", "ret", "part")


@query("ptf_03_asset_means", f"""
SELECT portfolio_id, symbol, {r_sql('avg(ret)', 12)} AS mean FROM ptf_complete GROUP BY portfolio_id, symbol""",
       _CTES)
def ptf_03_asset_means(spark, d):
    m = pt.asset_means(P(spark, d).train_complete)
    return m.select("portfolio_id", "symbol", rnd("mean", 12).alias("mean"))


@query("ptf_03_covariance", f"""
SELECT CAST(0 AS BIGINT) AS portfolio_id, a.symbol AS asset_a, b.symbol AS asset_b,
       {r_sql('covar_samp(a.ret, b.ret)', 12)} AS cov
FROM ptf_complete a JOIN ptf_complete b ON a.date = b.date GROUP BY a.symbol, b.symbol""", _CTES)
def ptf_03_covariance(spark, d):
    c = P(spark, d).covariance
    return c.select("portfolio_id", "asset_a", "asset_b", rnd("cov", 12).alias("cov"))


@query("ptf_06_target", f"SELECT portfolio_id, {r_sql('target', 12)} AS target FROM ptf_target", _CTES)
def ptf_06_target(spark, d):
    return P(spark, d).target.select("portfolio_id", rnd("target", 12).alias("target"))


@query("agg_19_benchmark_training_mean", f"SELECT {r_sql('target', 12)} AS mean_ret FROM ptf_target", _CTES)
def agg_19_benchmark_training_mean(spark, d):
    from ..operators.aggregates import series_mean
    p = P(spark, d)
    bench_train = p.split_ret.where((F.col("symbol") == BENCHMARK) & (F.col("part") == "train"))
    return series_mean(bench_train).select(rnd("mean_ret", 12).alias("mean_ret"))


@query("ptf_04_min_variance_weights", f"""
SELECT portfolio_id, symbol, {r_sql('weight', 6)} AS weight, 'optimal' AS status FROM ptf_weights
WHERE weight IS NOT NULL""", _CTES)
def ptf_04_min_variance_weights(spark, d):
    w = P(spark, d).weights
    return w.select("portfolio_id", "symbol", rnd("weight", 6).alias("weight"), "status")


@query("ptf_07_portfolio_returns", f"""
SELECT portfolio_id, date, {r_sql('ret', 9)} AS ret FROM ptf_port_ret""", _CTES)
def ptf_07_portfolio_returns(spark, d):
    r = P(spark, d).portfolio_returns
    return r.select("portfolio_id", "date", rnd("ret", 9).alias("ret"))


@query("ptf_08_annualized_comparison", f"""
SELECT portfolio_id, series, {r_sig_sql('ann_ret')} AS annualized_return, {r_sig_sql('ann_sd')} AS annualized_std,
       {r_sig_sql('ann_ret / ann_sd')} AS sharpe_ratio
FROM (SELECT portfolio_id, series, power(product(1.0 + ret), 252.0 / count(ret)) - 1 AS ann_ret,
             stddev_samp(ret) * sqrt(252.0) AS ann_sd FROM ptf_rp GROUP BY portfolio_id, series) s""", _CTES)
def ptf_08_annualized_comparison(spark, d):
    t = pf.annualized_table(P(spark, d).rp, 252, key=["portfolio_id", "series"], places=None)
    # compounded figures of a leveraged portfolio: compare 8 significant digits
    return t.select("portfolio_id", "series", *[rnd_sig(c).alias(c) for c in
                                                ("annualized_return", "annualized_std", "sharpe_ratio")])


@query("ptf_08_cumulative_test", f"""
SELECT portfolio_id, series, date,
       {r_sig_sql('coalesce(product(1.0 + ret) OVER (PARTITION BY portfolio_id, series ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0) - 1')} AS cumulative_return
FROM ptf_rp""", _CTES)
def ptf_08_cumulative_test(spark, d):
    c = pf.cumulative_series(P(spark, d).rp, ["portfolio_id", "series"], places=None)
    return c.select("portfolio_id", "series", "date", rnd_sig("cumulative_return").alias("cumulative_return"))


@query("ptf_05_long_only_weights", f"""
SELECT portfolio_id, symbol, {r_sql('CASE WHEN able THEN weight END', 6)} AS weight,
       CASE WHEN able THEN 'optimal' ELSE 'infeasible' END AS status
FROM fix_clamped""", _CTES | clamped_ctes("fix", "ptf_complete", "(SELECT target FROM ptf_target)"))
def ptf_05_long_only_weights(spark, d):
    w = P(spark, d).long_only_weights
    return w.select("portfolio_id", "symbol", rnd("weight", 6).alias("weight"), "status")


#: one portfolio per kept series: the series beside two fixed ones and the benchmark
_OPT = _CTES | {
    "opt_series": f"""
SELECT symbol, CAST('0x' || substr(md5(symbol), 1, 15) AS BIGINT) AS portfolio_id
FROM (SELECT DISTINCT symbol FROM eod_ret_l) s WHERE symbol NOT IN ('{A1}', '{A2}', '{BENCHMARK}')""",
    "opt_rows": f"""
SELECT o.portfolio_id, r.symbol, r.date, r.ret FROM opt_series o
JOIN eod_ret_l r ON r.symbol IN (o.symbol, '{A1}', '{A2}', '{BENCHMARK}')
WHERE r.date NOT IN (SELECT date FROM test_dates_l)""",
    "opt_means": """
SELECT portfolio_id, symbol, avg(ret) AS mu FROM opt_rows
WHERE (portfolio_id, date) IN (SELECT (portfolio_id, date) FROM opt_rows GROUP BY portfolio_id, date HAVING count(ret) = 4)
GROUP BY portfolio_id, symbol""",
    "opt_range": """
SELECT portfolio_id, count(*) AS n_assets, min(mu) AS lo, max(mu) AS hi, (SELECT target FROM ptf_target) AS t
FROM opt_means GROUP BY portfolio_id""",
}


def _beside(st):
    series = st.eod_ret_stored.select("symbol").distinct().where(~F.col("symbol").isin(A1, A2, BENCHMARK))
    pid = F.conv(F.substring(F.md5("symbol"), 1, 15), 16, 10).cast("long")
    assets = F.array(F.col("symbol"), F.lit(A1), F.lit(A2), F.lit(BENCHMARK))
    return series.select(pid.alias("portfolio_id"), F.explode(assets).alias("symbol"))


def _optimality(spark, d, long_only):
    p = PortfolioStudy(L_study(spark, d), _beside, store_universe=True)
    return pt.optimality(p.train_complete, p.target, p.long_only_weights if long_only else p.weights, long_only)


@query("ptf_04_optimality", """
SELECT portfolio_id, n_assets, 'optimal' AS status, CAST(1 AS DOUBLE) AS sum_weights, CAST(0 AS DOUBLE) AS gap,
       CAST(0 AS DOUBLE) AS kkt FROM opt_range""", _OPT)
def ptf_04_optimality(spark, d):
    o = _optimality(spark, d, False)
    return o.select("portfolio_id", "n_assets", "status", rnd("sum_weights", 6).alias("sum_weights"),
                    rnd("gap", 6).alias("gap"), rnd("kkt", 5).alias("kkt"))


@query("ptf_05_long_only_optimality", """
SELECT portfolio_id, n_assets, CASE WHEN able THEN 'optimal' ELSE 'infeasible' END AS status,
       CASE WHEN able THEN CAST(1 AS DOUBLE) END AS sum_weights, CASE WHEN able THEN CAST(0 AS DOUBLE) END AS gap,
       CASE WHEN able THEN TRUE END AS not_negative, CASE WHEN able THEN CAST(0 AS DOUBLE) END AS kkt
FROM (SELECT *, t BETWEEN lo - 1e-12 AND hi + 1e-12 AS able FROM opt_range) x""", _OPT)
def ptf_05_long_only_optimality(spark, d):
    """Where every date is complete the target is the benchmark's own mean, an end
    of the feasible range: hence the solver's tolerance in the oracle too."""
    o = _optimality(spark, d, True)
    return o.select("portfolio_id", "n_assets", "status", rnd("sum_weights", 6).alias("sum_weights"),
                    rnd("gap", 6).alias("gap"), (F.col("least_weight") >= 0).alias("not_negative"), rnd("kkt", 5).alias("kkt"))


# --- drawn portfolios ------------------------------------------------------------------------

N_BULK = 200
_POOL = f"SELECT DISTINCT symbol FROM eod_ret_l WHERE symbol <> '{BENCHMARK}'"
_MAR = "(SELECT target FROM ptf_target)"
#: 200 portfolios of three drawn series and the benchmark, held to the benchmark's mean return
_BULK = (_CTES | draw_ctes("bulk", N_BULK, 3, 100, _POOL, (BENCHMARK,)) | drawn_rows_ctes("bulk", 4) | weights_ctes("bulk", 4, _MAR) | {
    "bulk_port_ret": """
SELECT t.portfolio_id, t.date, CASE WHEN count(t.ret) = 4 THEN sum(w.weight * t.ret) END AS ret
FROM bulk_test t JOIN bulk_weights w USING (portfolio_id, symbol) GROUP BY ALL""",
    "bulk_rp": f"""
SELECT portfolio_id, 'ptf' AS series, date, ret FROM bulk_port_ret
UNION ALL SELECT p.portfolio_id, '{BENCHMARK}', p.date, b.ret FROM bulk_port_ret p
JOIN eod_ret_l b ON b.date = p.date AND b.symbol = '{BENCHMARK}'"""})
#: 200 of six drawn series and the benchmark
_WIDE = _CTES | draw_ctes("wide", N_BULK, 6, 100, _POOL, (BENCHMARK,)) | drawn_rows_ctes("wide", 7) | weights_ctes("wide", 7, _MAR)
#: 200 of three drawn series, held to the mean of their means
_TRIO = (_CTES | draw_ctes("trio", N_BULK, 3, 7, "SELECT DISTINCT symbol FROM eod_ret_l") | drawn_rows_ctes("trio", 3)
         | clamped_ctes("trio", "trio_complete", "(avg(r1) + avg(r2) + avg(r3)) / 3"))
_LONG = _CTES | draw_ctes("many", N_BULK, 6, 7, _POOL, (BENCHMARK,)) | drawn_rows_ctes("many", 7)


def _drawn(spark, d, n_assets, seed=100, **kw) -> PortfolioStudy:
    """The session's study of ``N_BULK`` drawn portfolios: its weights are solved and stored once."""
    st = L_study(spark, d)
    kept = st.__dict__.setdefault("_drawn", {})
    key = (n_assets, seed, *sorted(kw.items()))
    if key not in kept:
        kept[key] = PortfolioStudy.sampled(spark, d, W_LONG, n_portfolios=N_BULK, n_assets=n_assets, seed=seed, study=st, **kw)
    return kept[key]


@query("ptf_01_drawn_universe", """
SELECT portfolio_id, symbol, count(ret) AS n_obs FROM bulk_rows GROUP BY ALL""", _BULK)
def ptf_01_drawn_universe(spark, d):
    return _drawn(spark, d, 3).returns.groupBy("portfolio_id", "symbol").agg(F.count("ret").alias("n_obs"))


@query("ptf_02_drawn_split", f"""
SELECT portfolio_id, symbol, part, count(*) AS n_rows, count(ret) AS n_rets, min(date) AS first_date, max(date) AS last_date,
       {r_sql('sum(ret)', 9)} AS sum_ret
FROM (SELECT *, 'train' AS part FROM bulk_train UNION ALL SELECT *, 'test' FROM bulk_test) b GROUP BY ALL""", _BULK)
def ptf_02_drawn_split(spark, d):
    s = _drawn(spark, d, 3).split.groupBy("portfolio_id", "symbol", "part").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("ret").alias("n_rets"), F.min("date").alias("first_date"),
        F.max("date").alias("last_date"), F.sum("ret").alias("sum_ret"))
    return s.withColumn("sum_ret", rnd("sum_ret", 9))


@query("ptf_03_drawn_covariance", f"""
SELECT portfolio_id, asset_a, asset_b, {r_sql('cov', 12)} AS cov FROM bulk_cov""", _BULK)
def ptf_03_drawn_covariance(spark, d):
    return _drawn(spark, d, 3).covariance.withColumn("cov", rnd("cov", 12))


#: monthly order value of every customer with an order, in millions, 0 in a month without one
_VALUE = {
    "order_value": """
SELECT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) AS m, sum(o_totalprice) / 1000000 AS v FROM orders GROUP BY ALL""",
    "order_grid": """
SELECT 'C' || c.o_custkey AS symbol, m.m, coalesce(v.v, 0) AS v
FROM (SELECT DISTINCT o_custkey FROM order_value) c CROSS JOIN range((SELECT min(m) FROM order_value), (SELECT max(m) + 1 FROM order_value)) m(m)
LEFT JOIN order_value v ON v.o_custkey = c.o_custkey AND v.m = m.m""",
}


@query("ptf_03_covariance_all_customers", f"""
SELECT CAST(0 AS BIGINT) AS portfolio_id, a.symbol AS asset_a, b.symbol AS asset_b, {r_sql('covar_samp(a.v, b.v)', 8)} AS cov
FROM order_grid a JOIN order_grid b ON a.m = b.m AND a.symbol <= b.symbol GROUP BY a.symbol, b.symbol""", _VALUE)
def ptf_03_covariance_all_customers(spark, d):
    """One matrix over every customer (1,500 at sf0.01), in blocks."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate"))
    value = orders.groupBy(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("symbol"), month.alias("m")).agg(
        (F.sum("o_totalprice") / 1_000_000).alias("ret"))
    first, last, customers = orders.agg(F.min(month), F.max(month), F.approx_count_distinct("o_custkey")).first()
    n = (last or 0) - (first or 0) + 1
    packed = pk.pack_series(value.withColumn("day", F.col("m") - F.lit(first or 0)), n).select(
        "symbol", F.transform("rets", lambda r: F.coalesce(r, F.lit(0.0))).alias("rets"))
    universe = value.select(F.lit(0).cast("long").alias("portfolio_id"), "symbol")
    c = pk.covariance_blocks(universe, packed, None, n, both=False, tasks=pk.pair_tasks(customers))
    return c.withColumn("cov", rnd_many("cov", 8))


@query("ptf_04_drawn_weights", f"""
SELECT portfolio_id, symbol, {r_sql('weight', 6)} AS weight, 'optimal' AS status FROM bulk_weights""", _BULK)
def ptf_04_drawn_weights(spark, d):
    return _drawn(spark, d, 3).weights.withColumn("weight", rnd("weight", 6))


@query("ptf_04_sampled_weights", f"""
SELECT portfolio_id, symbol, {r_sql('weight', 6)} AS weight, 'optimal' AS status FROM wide_weights""", _WIDE)
def ptf_04_sampled_weights(spark, d):
    return _drawn(spark, d, 6).weights.withColumn("weight", rnd("weight", 6))


@query("ptf_05_drawn_long_only", f"""
SELECT portfolio_id, symbol, {r_sql('weight', 6)} AS weight, 'optimal' AS status FROM trio_clamped""", _TRIO)
def ptf_05_drawn_long_only(spark, d):
    return _drawn(spark, d, 3, 7, include_benchmark=False, goal=pt.NAIVE).long_only_weights.withColumn("weight", rnd("weight", 6))


@query("ptf_05_drawn_optimality", """
SELECT portfolio_id, count(DISTINCT symbol) AS n_assets, 'optimal' AS status, CAST(1 AS DOUBLE) AS sum_weights, CAST(0 AS DOUBLE) AS gap,
       TRUE AS not_negative, CAST(0 AS DOUBLE) AS kkt FROM many_complete GROUP BY portfolio_id""", _LONG)
def ptf_05_drawn_optimality(spark, d):
    """Seven assets each; the conditions of the optimum, bounds included, are measured in the JVM."""
    p = _drawn(spark, d, 6, 7, goal=pt.NAIVE)
    o = pt.optimality(p.train_complete, p.target, p.long_only_weights, bounded=True)
    return o.select("portfolio_id", "n_assets", "status", rnd("sum_weights", 6).alias("sum_weights"), rnd("gap", 6).alias("gap"),
                    (F.col("least_weight") >= 0).alias("not_negative"), rnd("kkt", 5).alias("kkt"))


@query("ptf_07_drawn_returns", f"""
SELECT portfolio_id, date, {r_sql('ret', 8)} AS ret FROM bulk_port_ret""", _BULK)
def ptf_07_drawn_returns(spark, d):
    return _drawn(spark, d, 3).portfolio_returns.withColumn("ret", rnd("ret", 8))


@query("ptf_08_drawn_comparison", f"""
SELECT portfolio_id, series, {r_sig_sql('ann_ret', 6)} AS annualized_return, {r_sig_sql('ann_sd', 6)} AS annualized_std,
       {r_sig_sql('ann_ret / ann_sd', 6)} AS sharpe_ratio
FROM (SELECT portfolio_id, series, power(product(1.0 + ret), 252.0 / count(ret)) - 1 AS ann_ret,
             stddev_samp(ret) * sqrt(252.0) AS ann_sd FROM bulk_rp GROUP BY portfolio_id, series) s""", _BULK)
def ptf_08_drawn_comparison(spark, d):
    t = pf.annualized_table(_drawn(spark, d, 3).rp, 252, key=["portfolio_id", "series"], places=None)
    return t.select("portfolio_id", "series", *[rnd_sig(c, 6).alias(c) for c in
                                                ("annualized_return", "annualized_std", "sharpe_ratio")])


@query("ts_10_drawn_universe", "SELECT portfolio_id, symbol FROM wide_universe", _WIDE)
def ts_10_drawn_universe(spark, d):
    return _drawn(spark, d, 6).universe


@query("ts_10_sampled_by_pattern", "SELECT portfolio_id, symbol FROM named_universe",
       draw_ctes("named", 1, 3, 100, "SELECT DISTINCT symbol FROM eod_ret_l WHERE regexp_matches(symbol, '^[lL]')"))
def ts_10_sampled_by_pattern(spark, d):
    """The script's commented variant: a seeded sample of 3 series among the
    names matching a pattern (``^[lL].*`` on these tables)."""
    from ..operators.series import symbols_matching
    st = L_study(spark, d)
    return pt.sampled_universe(symbols_matching(st.eod_ret, "^[lL].*"), n_portfolios=1, n_assets=3, seed=100)


def L_study(spark, d):
    return stored_study(spark, d, W_LONG)
