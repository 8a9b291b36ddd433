import datetime as dt
import math

import numpy as np
import pytest

from quotecraft.operators import performance as PF

D = dt.date


def _ret(spark, values, symbol="s"):
    rows = [(symbol, D(2024, 1, 1) + dt.timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, date date, ret double")


@pytest.mark.parametrize("v,expected", [(10, 2.2281), (30, 2.0423), (100, 1.9840)])
def test_t_quantile(spark, v, expected):
    from pyspark.sql import functions as F
    got = spark.range(1).select(PF.t_quantile_975(F.lit(v)).alias("t")).first().t
    assert got == pytest.approx(expected, abs=1e-4)


def test_stats_table_against_numpy(spark):
    x = [0.01, -0.02, 0.03, None, 0.005, -0.01, 0.02]
    row = PF.stats_table(_ret(spark, x), places=None).first()
    v = np.array([a for a in x if a is not None])
    assert row.observations == 6 and row.nas == 1
    assert row.median == pytest.approx(np.median(v))
    assert row.quartile_1 == pytest.approx(np.quantile(v, 0.25))
    assert row.stdev == pytest.approx(v.std(ddof=1))
    m = v - v.mean()
    assert row.skewness == pytest.approx((m ** 3).mean() / (m ** 2).mean() ** 1.5)
    assert row.kurtosis == pytest.approx((m ** 4).mean() / (m ** 2).mean() ** 2 - 3)
    assert row.geometric_mean == pytest.approx(np.prod(1 + v) ** (1 / 6) - 1)


def test_one_row_series(spark):
    row = PF.stats_table(_ret(spark, [0.01]), places=None).first()
    assert row.stdev is None and row.observations == 1


def test_cumulative_and_drawdown(spark):
    r = _ret(spark, [0.1, -0.5, None, 1.0, -1.0])
    cum = [x.cumulative_return for x in PF.cumulative_series(r, places=None).orderBy("date").collect()]
    assert cum == pytest.approx([0.1, -0.45, -0.45, 0.1, -1.0])
    dd = [x.drawdown for x in PF.drawdown_series(r, places=None).orderBy("date").collect()]
    assert dd == pytest.approx([0.0, -0.5, -0.5, 0.0, -1.0])


def test_boxplot_fivenum(spark):
    x = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 100.0]
    row = PF.boxplot_stats(_ret(spark, x), places=None).first()
    assert (row.lower_hinge, row.median, row.upper_hinge) == (2.5, 4.0, 5.5)
    assert row.upper_whisker == 6.0 and row.n_outliers == 1
    out = PF.boxplot_outliers(_ret(spark, x)).collect()
    assert [o.ret for o in out] == [100.0]


def test_capm_self_and_p_value(spark):
    a = _ret(spark, [0.01, 0.02, -0.01, 0.03, 0.0, -0.02], "a")
    b = _ret(spark, [0.01, 0.02, -0.01, 0.03, 0.0, -0.02], "b")
    row = PF.capm_table(a, b.drop("symbol"), places=None).first()
    assert row.beta == pytest.approx(1.0) and row.alpha == pytest.approx(0.0, abs=1e-12)
    assert row.information_ratio is None


def test_correlation_p_value(spark):
    """Against the density of r for no correlation, integrated by Simpson's rule."""
    def tail(r, n):
        # (1 - x^2)^((n - 4) / 2) with x = sin(u): cos(u)^(n - 3), smooth for every n >= 3
        def area(a, b, k=20000):
            h = (b - a) / k
            f = [math.cos(a + i * h) ** (n - 3) for i in range(k + 1)]
            return h / 3 * (f[0] + f[-1] + 4 * sum(f[1:-1:2]) + 2 * sum(f[2:-1:2]))
        return area(math.asin(abs(r)), math.pi / 2) / area(0.0, math.pi / 2)

    cases = [(r, n) for r in (0.0, 0.1, -0.5, 0.9, -0.999) for n in (3, 4, 5, 6, 7, 12, 31, 400)]
    rows = cases + [(1.0, 10), (-1.0, 9), (None, 10), (0.5, 2), (0.5, None), (float("nan"), 10)]
    df = spark.createDataFrame(rows, "correlation double, n long")
    got = {(str(x.correlation), x.n): x.correlation_p_value for x in PF.with_correlation_p_value(df).collect()}
    for r, n in cases:
        assert got[(str(r), n)] == pytest.approx(tail(r, n), abs=1e-9)
    assert got[("-0.5", 12)] == pytest.approx(0.0978, abs=1e-4)
    assert got[("1.0", 10)] == pytest.approx(0.0, abs=1e-12) and got[("-1.0", 9)] == pytest.approx(0.0, abs=1e-12)
    assert [got[k] for k in (("None", 10), ("0.5", 2), ("0.5", None), ("nan", 10))] == [None] * 4


def test_periods_per_year(spark):
    daily = [("d", D(2024, 1, 1) + dt.timedelta(days=i), 0.01) for i in range(0, 60) if (i % 7) not in (5, 6)]
    monthly = [("m", D(2020 + i // 12, i % 12 + 1, 28), 0.01) for i in range(24)]
    df = spark.createDataFrame(daily + monthly, "symbol string, date date, ret double")
    got = {r.symbol: r.scale for r in PF.periods_per_year(df).collect()}
    assert got == {"d": 252, "m": 12}
