import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quotecraft.operators import portfolio as PT


def _problem(seed, n):
    rng = np.random.default_rng(seed)
    x = rng.normal(0.001, 0.02, size=(120, n)) + rng.normal(0, 0.002, size=n)
    return x.mean(axis=0), np.cov(x, rowvar=False, ddof=1)


@settings(max_examples=40, deadline=None)
@given(seed=st.integers(0, 10_000), n=st.integers(2, 8), frac=st.floats(0.0, 1.0))
def test_equality_constrained_properties(seed, n, frac):
    mu, cov = _problem(seed, n)
    t = mu.min() + frac * (mu.max() - mu.min())
    w, status = PT.min_variance(mu, cov, t)
    assert status == "optimal"
    assert w.sum() == pytest.approx(1.0, abs=1e-9)
    assert w @ mu == pytest.approx(t, abs=1e-9)
    # equal marginal condition: 2*cov@w lies in span(1, mu)
    g = 2 * cov @ w
    a = np.vstack([np.ones(n), mu]).T
    lam, *_ = np.linalg.lstsq(a, g, rcond=None)
    assert np.allclose(a @ lam, g, atol=1e-9)


def test_three_asset_closed_form():
    mu, cov = _problem(7, 3)
    t = mu.mean()
    w, _ = PT.min_variance(mu, cov, t)
    m1, m2, m3 = mu
    d = np.array([m3 - m2, m1 - m3, m2 - m1])
    u = (t - m2) / (m1 - m2)
    w0 = np.array([u, 1 - u, 0.0])
    closed = w0 - (d @ cov @ w0) / (d @ cov @ d) * d
    assert np.allclose(w, closed, atol=1e-10)


@settings(max_examples=30, deadline=None)
@given(seed=st.integers(0, 10_000), frac=st.floats(0.05, 0.95))
def test_long_only_against_grid(seed, frac):
    mu, cov = _problem(seed, 3)
    t = mu.min() + frac * (mu.max() - mu.min())
    w, status = PT.min_variance_long_only(mu, cov, t)
    assert status == "optimal"
    assert (w >= -1e-12).all() and w.sum() == pytest.approx(1.0) and w @ mu == pytest.approx(t, abs=1e-10)
    # brute force along the feasible segment set: w3 free, w1, w2 from the two equalities
    best = np.inf
    m1, m2, m3 = mu
    for w3 in np.linspace(0, 1, 4001):
        # w1 + w2 = 1 - w3, m1 w1 + m2 w2 = t - m3 w3
        if abs(m1 - m2) < 1e-15:
            continue
        w1 = (t - m3 * w3 - m2 * (1 - w3)) / (m1 - m2)
        w2 = 1 - w3 - w1
        if w1 < -1e-12 or w2 < -1e-12:
            continue
        v = np.array([w1, w2, w3])
        best = min(best, v @ cov @ v)
    assert w @ cov @ w <= best + 1e-12


def test_long_only_infeasible_target():
    mu, cov = _problem(3, 4)
    w, status = PT.min_variance_long_only(mu, cov, mu.max() + 0.01)
    assert w is None and status == "infeasible"


def test_singular():
    mu = np.array([0.01, 0.01])
    cov = np.array([[1.0, 1.0], [1.0, 1.0]])
    w, status = PT.min_variance(mu, cov, 0.01)
    assert w is None and status == "singular"


def test_moments_drop_incomplete_dates():
    x = np.array([[[0.1, np.nan, 0.3, 0.5], [0.2, 0.3, 0.1, 0.4]]])
    mu, cov, n = PT.moments(x)
    full = x[0][:, [0, 2, 3]]
    assert n.tolist() == [3] and np.allclose(mu[0], full.mean(axis=1)) and np.allclose(cov[0], np.cov(full, ddof=1))


def _returns(spark, x, symbols):
    """Rows (symbol, date, day, ret) of a (symbols, days) matrix; NaN is NULL, infinity is no row."""
    import datetime as dt
    rows = [(s, dt.date(2024, 1, 1) + dt.timedelta(days=d), d, None if np.isnan(v) else float(v))
            for s, series in zip(symbols, x, strict=True) for d, v in enumerate(series) if not np.isinf(v)]
    return spark.createDataFrame(rows, "symbol string, date date, day int, ret double")


@pytest.fixture(scope="module")
def gappy(spark):
    """40 series of 150 days with NULLs and missing rows, one without any return, and 30 portfolios of them."""
    rng = np.random.default_rng(9)
    x = rng.normal(0.001, 0.02, (41, 150)) + rng.normal(0, 0.002, (41, 1))
    x[rng.random(x.shape) < 0.004] = np.nan
    x[rng.random(x.shape) < 0.003] = np.inf
    x[7, 64:128] = np.inf                                    # a whole word of the bitmap
    x[40] = np.nan
    symbols = [f"S{i:02d}" for i in range(41)]
    universe = [(p, symbols[i]) for p in range(30) for i in rng.choice(40, 2 + p % 7, replace=False)]
    universe += [(30, s) for s in symbols[:40]] + [(31, "S40"), (31, "S01"), (32, "S03")]
    u = spark.createDataFrame(universe, "portfolio_id long, symbol string")
    clean = np.where(np.isinf(x), np.nan, x)
    return symbols, clean, u, _returns(spark, x, symbols), universe


def test_packed_series_and_bitmaps(spark, gappy):
    from quotecraft.operators import packed as pk
    symbols, x, u, ret, universe = gappy
    got = {r.symbol: [np.nan if v is None else v for v in r.rets] for r in pk.pack_series(ret, 150).collect()}
    assert set(got) == set(symbols)
    for s, series in zip(symbols, x, strict=True):
        assert np.array_equal(got[s], series, equal_nan=True)
    days = {r.portfolio_id: pk.days_of(r.words, 150) for r in pk.complete_days(u, pk.day_bitmaps(ret)).collect()}
    for p in range(33):
        mine = [symbols.index(s) for q, s in universe if q == p]
        assert (days[p] == ~np.isnan(x[mine]).any(axis=0)).all()


@pytest.mark.parametrize("block", [256, 4, 1])
def test_blocked_covariance(spark, gappy, block):
    from quotecraft.operators import packed as pk
    symbols, x, u, ret, universe = gappy
    packed = pk.pack_series(ret, 150)
    got = {}
    for r in pk.covariance_blocks(u, packed, pk.complete_days(u, pk.day_bitmaps(ret)), 150, block).collect():
        assert (r.portfolio_id, r.asset_a, r.asset_b) not in got
        got[r.portfolio_id, r.asset_a, r.asset_b] = r["cov"]
    for p in range(33):
        mine = sorted(s for q, s in universe if q == p)
        m = x[[symbols.index(s) for s in mine]]
        m = m[:, ~np.isnan(m).any(axis=0)]
        for i, a in enumerate(mine):
            for j, b in enumerate(mine):
                if m.shape[1] < 2:
                    assert got[p, a, b] is None
                else:
                    assert got[p, a, b] == pytest.approx(np.cov(m[i], m[j])[0, 1], abs=1e-15)
    once = pk.covariance_blocks(u, packed, pk.complete_days(u, pk.day_bitmaps(ret)), 150, block, both=False).collect()
    assert len(once) == sum(1 for p, a, b in got if a <= b) and all(r.asset_a <= r.asset_b for r in once)


def test_pairs_become_rows_in_the_jvm(spark):
    """70 assets in blocks of 50: blocks are longer than a strip, and one of them has only assets without a series."""
    from quotecraft.operators import packed as pk
    rng = np.random.default_rng(5)
    symbols, x = [f"S{i:03d}" for i in range(170)], rng.normal(0, 1e-4, (70, 12))
    u = spark.createDataFrame([(7, s) for s in symbols], "portfolio_id long, symbol string")
    packed = pk.pack_series(_returns(spark, x, symbols[:70]), 12)
    want = np.cov(x)
    for both in (False, True):
        c = pk.covariance_blocks(u, packed, None, 12, 50, both)
        got = {(r.asset_a, r.asset_b): r["cov"] for r in c.collect()}
        assert len(got) == c.count() == (70 * 70 if both else 70 * 71 // 2)
        assert all(got[a, b] == pytest.approx(want[symbols.index(a), symbols.index(b)], abs=1e-18) for a, b in got)
        # Python hands over arrays, not pairs
        made = [s for s in c._jdf.queryExecution().executedPlan().toString().splitlines() if "FlatMapGroupsInArrow" in s]
        assert made and all("covs" in s and "asset_b" not in s for s in made)


def test_pairs_of_one_portfolio_are_dealt_out(spark):
    """120 short series fit a broadcast, and one portfolio is one key: its 120 pairs of blocks still go to many tasks."""
    from pyspark.sql import functions as F
    from quotecraft.operators import packed as pk
    symbols, x = [f"S{i:03d}" for i in range(120)], np.random.default_rng(7).normal(0, 1, (120, 6))
    u = spark.createDataFrame([(7, s) for s in symbols] + [(None, "S000")], "portfolio_id long, symbol string")
    packed = pk.pack_series(_returns(spark, x, symbols), 6)
    want = np.cov(x)
    assert pk.pair_tasks(120, 8) == 120 and pk.pair_tasks(0) == pk.pair_tasks(1) == 1 and pk.pair_tasks(10**9) == pk.TASKS
    for tasks, least in ((None, 8), (pk.pair_tasks(120, 8), 50)):
        c = pk.covariance_blocks(u, packed, None, 6, 8, False, tasks).withColumn("task", F.spark_partition_id()).collect()
        got = {(r.asset_a, r.asset_b): r["cov"] for r in c}
        assert len(got) == len(c) == 120 * 121 // 2 and {r.portfolio_id for r in c} == {7}
        assert all(got[a, b] == pytest.approx(want[symbols.index(a), symbols.index(b)], abs=1e-12) for a, b in got)
        assert len({r.task for r in c}) >= least


def test_all_customers_pairs_run_in_many_tasks(spark, tmp_path):
    """3,100 customers: four blocks, ten pairs of blocks, although their series are less than a MB."""
    from datetime import datetime
    from pyspark.sql import functions as F
    from quotecraft.queries import queries
    orders = spark.range(6200).select((F.col("id") % 3100).alias("o_custkey"), (F.col("id") * 7.5 + 100).alias("o_totalprice"),
                                      F.lit(datetime(2020, 1, 15)).alias("o_orderdate"), F.col("id").alias("_k"))
    orders = orders.withColumn("o_orderdate", F.expr("timestampadd(MONTH, cast(_k % 5 as int), o_orderdate)")).drop("_k")
    orders.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    c = queries()["ptf_03_covariance_all_customers"](spark, str(tmp_path))
    per_task = c.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in per_task) == 3100 * 3101 // 2
    assert len(per_task) >= 4


def test_rounding_of_many_values(spark):
    from quotecraft.queries.registry import rnd, rnd_many
    rng = np.random.default_rng(6)
    v = [None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0, -1e-12, 5e-9, -5e-9, 1.5e-8, 2.5e-8, 0.285, 1234.000000005, 1e4, 1e300, -7e12 / 3]
    v += rng.normal(0, 1e-3, 3000).tolist() + (rng.integers(-10**9, 10**9, 3000) / 1e9).tolist() + ((rng.integers(-10**6, 10**6, 3000) + 0.5) / 1e8).tolist()
    df = spark.createDataFrame([(x,) for x in v], "x double").select(rnd("x", 8).alias("a"), rnd_many("x", 8).alias("b"))
    assert df.where("not (a <=> b)").count() == 0


@pytest.mark.parametrize("long_only", [False, True])
def test_stacked_weights_equal_single_solves(spark, gappy, long_only):
    from quotecraft.operators import packed as pk
    symbols, x, u, ret, universe = gappy
    packed = pk.pack_series(ret, 150)
    got = {}
    for r in PT.solve_weights(u, packed, 150, 120, PT.NAIVE, long_only).collect():
        got.setdefault(r.portfolio_id, {})[r.symbol] = (r.weight, r.status)
    for p in range(31):
        mine = sorted(s for q, s in universe if q == p)
        m = x[[symbols.index(s) for s in mine]][:, :120]
        m = m[:, ~np.isnan(m).any(axis=0)]
        mu, cov = m.mean(axis=1), np.cov(m)
        w, status = (PT.min_variance_long_only if long_only else PT.min_variance)(mu, cov, mu.mean())
        if w is None:
            assert p == 30 and not long_only or len(mine) > m.shape[1]    # more assets than complete days
            continue
        assert [got[p][s][0] for s in mine] == pytest.approx(list(w), abs=1e-8)
        assert {got[p][s][1] for s in mine} == {status}
    assert {s for _, s in got[31].values()} == {"too_few_dates"} and all(w is None for w, _ in got[31].values())


def test_critical_line_meets_the_conditions():
    """Random problems of up to 24 assets: no better direction exists at the solution."""
    for seed in range(300):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(2, 25))
        x = rng.normal(0.001, 0.02, (120, n)) + rng.normal(0, 0.002, n)
        mu, cov = x.mean(axis=0), np.cov(x, rowvar=False)
        t = mu.min() + rng.uniform(0.01, 0.99) * (mu.max() - mu.min())
        w, status = PT.min_variance_long_only(mu, cov, t)
        assert status == "optimal" and (w >= 0).all()
        assert w.sum() == pytest.approx(1) and w @ mu == pytest.approx(t, abs=1e-12)
        g, held = cov @ w, w > 0
        a = np.column_stack([mu[held], np.ones(held.sum())])
        slope, at = np.linalg.lstsq(a, g[held], rcond=None)[0]
        off = g - slope * mu - at
        assert np.abs(off[held]).max() < 1e-7 * np.abs(g).max()
        if held.sum() > 1:
            assert off[~held].min(initial=0) > -1e-7 * np.abs(g).max()


def test_critical_line_at_the_ends_and_with_ties():
    cov = np.diag([1.0, 2.0, 3.0])
    w, status = PT.min_variance_long_only(np.array([0.01, 0.01, 0.02]), cov, 0.01)
    assert status == "optimal" and w == pytest.approx([2 / 3, 1 / 3, 0])
    w, _ = PT.min_variance_long_only(np.array([0.01, 0.01, 0.02]), cov, 0.02)
    assert w == pytest.approx([0, 0, 1])
    w, _ = PT.min_variance_long_only(np.array([0.01, 0.01, 0.01]), cov, None)
    assert w == pytest.approx(np.array([6, 3, 2]) / 11)
    w, _ = PT.min_variance_long_only(np.array([0.01, 0.01, 0.02]), cov, 0.015)
    assert w == pytest.approx([1 / 3, 1 / 6, 1 / 2], abs=1e-6)
    assert PT.min_variance_long_only(np.array([0.01, 0.02]), np.full((2, 2), np.nan), 0.015) == (None, "singular")


def test_badly_scaled_problems_are_solved():
    """Tiny variances beside large means are no singular system."""
    mu, cov = _problem(5, 4)
    want, _ = PT.min_variance(mu, cov, mu.mean())
    for k in (1e-9, 1e6):
        w, status = PT.min_variance(mu * k, cov * k * 1e-6, mu.mean() * k)
        assert status == "optimal" and w == pytest.approx(want, abs=1e-7)


def test_draws_are_distinct_uniform_and_repeated_by_duckdb(spark):
    import collections

    import duckdb

    from quotecraft.queries.q_portfolio import draw_ctes
    names = [f"S{i}" for i in range(9)]
    pool = spark.createDataFrame([(s,) for s in names], "symbol string")
    got = sorted((r.portfolio_id, r.symbol) for r in PT.sampled_universe(pool, 3000, 4, seed=5).collect())
    values = ", ".join(f"('{s}')" for s in names)
    ctes = draw_ctes("x", 3000, 4, 5, f"SELECT symbol FROM (VALUES {values}) v(symbol)")
    sql = "WITH " + ", ".join(f"{k} AS ({v})" for k, v in ctes.items()) + " SELECT portfolio_id, symbol FROM x_universe"
    assert got == sorted(duckdb.sql(sql).fetchall())
    assert len(set(got)) == 3000 * 4
    seen = collections.Counter(s for _, s in got)
    assert all(abs(n - 3000 * 4 / 9) < 5 * (3000 * 4 / 9 * 5 / 9) ** 0.5 for n in seen.values())


def test_sampled_universe_distinct_and_repeatable(spark):
    syms = spark.createDataFrame([(f"S{i}",) for i in range(30)] + [("SP500TR",)], "symbol string")
    u1 = PT.sampled_universe(syms, 20, 5, seed=1, include=("SP500TR",)).collect()
    u2 = PT.sampled_universe(syms, 20, 5, seed=1, include=("SP500TR",)).collect()
    assert sorted(u1) == sorted(u2)
    per = {}
    for r in u1:
        per.setdefault(r.portfolio_id, []).append(r.symbol)
    assert len(per) == 20
    for v in per.values():
        assert len(v) == 6 and len(set(v)) == 6 and "SP500TR" in v


def test_sampled_weights_properties(spark):
    from quotecraft.params import W_LONG
    from quotecraft.plans.portfolio_study import PortfolioStudy
    p = PortfolioStudy.sampled(spark, "/root/testdata/sf0.01", W_LONG, n_portfolios=12, n_assets=4)
    w = p.weights.toPandas()
    assert w.portfolio_id.nunique() == 12
    ok = w[w.status == "optimal"]
    sums = ok.groupby("portfolio_id").weight.sum()
    assert np.allclose(sums, 1.0, atol=1e-8)


def test_portfolio_returns_of_a_symbol_in_every_portfolio(spark):
    import datetime as dt
    u = spark.createDataFrame([(p, s) for p in range(40) for s in ("B", f"S{p % 5}")],
                              "portfolio_id long, symbol string")
    ret = spark.createDataFrame([(s, dt.date(2024, 1, 1) + dt.timedelta(days=d), 0.01 * d)
                                 for s in ["B"] + [f"S{i}" for i in range(5)] for d in range(10)],
                                "symbol string, date date, ret double")
    got = sorted(tuple(r) for r in PT.portfolio_returns(u, ret).collect())
    by_symbol = {}
    for r in ret.collect():
        by_symbol.setdefault(r.symbol, []).append((r.date, r.ret))
    assert got == sorted((r.portfolio_id, r.symbol, d, x) for r in u.collect() for d, x in by_symbol[r.symbol])


def test_a_pool_too_small_to_draw_from_is_an_error(spark):
    import pytest
    pool = spark.createDataFrame([(f"S{i}",) for i in range(5)], "symbol string")
    assert PT.sampled_universe(pool, 3, 5).count() == 15
    with pytest.raises(Exception, match="cannot draw 12"):
        PT.sampled_universe(pool, 3, 12).collect()


def test_dense_index(spark):
    from quotecraft.operators.series import dense_index
    df = spark.createDataFrame([(f"K{i % 500}",) for i in range(2000)], "symbol string")
    rows = dense_index(df, "symbol", buckets=7).collect()
    assert len(rows) == 500 and sorted(r.idx for r in rows) == list(range(1, 501))
    again = {r.symbol: r.idx for r in dense_index(df, "symbol", buckets=7).collect()}
    assert again == {r.symbol: r.idx for r in rows}


def test_sampled_by_pattern(spark):
    from quotecraft.queries import queries
    rows = queries()["ts_10_sampled_by_pattern"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 3 and len({r.symbol for r in rows}) == 3
    assert all(r.symbol[0] in "lL" for r in rows)


def test_optimality_tells_wrong_weights(spark):
    """Solved weights meet the conditions; weights moved along the budget do not."""
    import datetime as dt

    rng = np.random.default_rng(3)
    x = rng.normal([0.001, 0.002, 0.004, 0.003], [0.01, 0.02, 0.03, 0.02], (80, 4))
    rows = [(7, dt.date(2024, 1, 1) + dt.timedelta(days=i), s, float(x[i, j]))
            for i in range(80) for j, s in enumerate("abcd")]
    train = spark.createDataFrame(rows, "portfolio_id long, date date, symbol string, ret double")
    target = spark.createDataFrame([(7, float(x.mean()))], "portfolio_id long, target double")
    w, status = PT.min_variance(x.mean(axis=0), np.cov(x, rowvar=False), float(x.mean()))
    frame = lambda v: spark.createDataFrame(
        [(7, s, float(k), status) for s, k in zip("abcd", v)],
        "portfolio_id long, symbol string, weight double, status string")
    good = PT.optimality(train, target, frame(w)).first()
    assert (good.n_assets, good.status) == (4, "optimal")
    assert good.sum_weights == pytest.approx(1) and good.gap < 1e-9 and good.kkt < 1e-9
    assert good.least_weight == pytest.approx(w.min())
    bad = PT.optimality(train, target, frame(w + np.array([0.2, -0.2, 0.1, -0.1]))).first()
    assert bad.sum_weights == pytest.approx(1) and bad.kkt > 1e-3
    # without short positions: the solution passes, a feasible portfolio beside it does not
    mu = x.mean(axis=0)
    t = mu.min() + 0.9 * (mu.max() - mu.min())
    goal = spark.createDataFrame([(7, float(t))], "portfolio_id long, target double")
    v, _ = PT.min_variance_long_only(mu, np.cov(x, rowvar=False), t)
    good = PT.optimality(train, goal, frame(v), bounded=True).first()
    assert good.kkt < 1e-9 and good.gap < 1e-9 and good.least_weight == 0
    top, low = int(np.argmax(mu)), int(np.argmin(mu))
    ends = np.zeros(4)
    ends[top] = (t - mu[low]) / (mu[top] - mu[low])
    ends[low] = 1 - ends[top]
    bad = PT.optimality(train, goal, frame(ends), bounded=True).first()
    assert bad.gap < 1e-9 and bad.least_weight == 0 and (bad.kkt > 1e-3 or np.allclose(ends, v))
