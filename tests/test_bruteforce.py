"""Many random series in one Spark job, each checked against a plain-Python
brute force of the same definition."""

import datetime as dt
import random

import numpy as np
import pytest

from quotecraft.operators import calendar as C
from quotecraft.operators import performance as PF
from quotecraft.operators import prices as P
from quotecraft.operators import returns as R

D0 = dt.date(2024, 1, 1)


def locf_brute(xs, maxgap):
    out, i, n = list(xs), 0, len(xs)
    while i < n:
        if xs[i] is None:
            j = i
            while j < n and xs[j] is None:
                j += 1
            if i > 0 and (j - i) <= maxgap:
                for k in range(i, j):
                    out[k] = xs[i - 1]
            i = j
        else:
            i += 1
    return out


def test_locf_random(spark):
    rng = random.Random(7)
    series = {}
    for s in range(60):
        n = rng.randint(1, 25)
        p_null = rng.choice([0.0, 0.2, 0.5, 0.8])
        series[f"s{s}"] = [None if rng.random() < p_null else round(rng.uniform(1, 9), 3) for _ in range(n)]
    rows = [(k, D0 + dt.timedelta(days=i), v) for k, xs in series.items() for i, v in enumerate(xs)]
    df = spark.createDataFrame(rows, "symbol string, date date, px double")
    for maxgap in (0, 1, 3):
        got = {}
        for r in P.locf(df, maxgap=maxgap).collect():
            got.setdefault(r.symbol, {})[r.date] = r.price
        for k, xs in series.items():
            exp = locf_brute(xs, maxgap)
            assert [got[k][D0 + dt.timedelta(days=i)] for i in range(len(xs))] == exp, (k, maxgap)


def test_strict_returns_random(spark):
    rng = random.Random(11)
    cal = C.enrich_calendar(C.trading_calendar(spark, "2023-12-01", "2024-02-29"))
    cal_rows = {r.date: r for r in cal.collect()}
    days = sorted(cal_rows)
    rows = []
    for s in range(25):
        for d in days:
            if rng.random() < (0.75 if cal_rows[d].trading else 0.15):
                rows.append((f"s{s}", d, float(np.float32(rng.uniform(5, 50)))))
    eod = spark.createDataFrame(rows, "symbol string, date date, adj_close float")
    price = {(s, d): p for s, d, p in rows}
    exp = {}
    for s, d, p in rows:
        ptd = cal_rows[d].prev_trading_day
        if ptd is not None and (s, ptd) in price:
            exp[(s, d)] = float(np.float32(np.float32(p) / np.float32(price[(s, ptd)]))) - 1.0
    got = {(r.symbol, r.date): r.ret for r in R.strict_returns(eod, cal).collect()}
    assert got == exp
    joined = {(r.symbol, r.date): r.ret for r in R.strict_returns_join(eod, cal).collect()}
    assert joined == exp


def fivenum(x):
    x = sorted(x)
    n = len(x)
    n4 = ((n + 3) // 2) / 2
    d = [1, n4, (n + 1) / 2, n + 1 - n4, n]
    return [0.5 * (x[int(np.floor(v)) - 1] + x[int(np.ceil(v)) - 1]) for v in d]


def test_boxplot_random(spark):
    rng = np.random.default_rng(3)
    data = {f"s{i}": list(rng.standard_t(3, size=int(rng.integers(1, 40)))) for i in range(40)}
    rows = [(k, D0 + dt.timedelta(days=j), float(v)) for k, xs in data.items() for j, v in enumerate(xs)]
    df = spark.createDataFrame(rows, "symbol string, date date, ret double")
    got = {r.symbol: r for r in PF.boxplot_stats(df, places=None).collect()}
    for k, xs in data.items():
        f = fivenum(xs)
        iqr = f[3] - f[1]
        inside = [v for v in xs if f[1] - 1.5 * iqr <= v <= f[3] + 1.5 * iqr]
        r = got[k]
        assert (r.lower_hinge, r.median, r.upper_hinge) == pytest.approx((f[1], f[2], f[3]))
        assert r.lower_whisker == min(inside) and r.upper_whisker == max(inside)
        assert r.n_outliers == len(xs) - len(inside)


def test_capm_random(spark):
    rng = np.random.default_rng(5)
    n = 120
    rb = rng.normal(0.0005, 0.01, n)
    rows = [("B", D0 + dt.timedelta(days=i), float(v)) for i, v in enumerate(rb)]
    truth = {}
    for a in range(8):
        ra = 0.0002 * a + (0.5 + 0.2 * a) * rb + rng.normal(0, 0.005, n)
        miss = rng.random(n) < 0.05
        rows += [(f"A{a}", D0 + dt.timedelta(days=i), None if miss[i] else float(v)) for i, v in enumerate(ra)]
        keep = ~miss
        beta, alpha = np.polyfit(rb[keep], ra[keep], 1)
        up = keep & (rb > 0)
        beta_p = np.polyfit(rb[up], ra[up], 1)[0]
        te = np.std(ra[keep] - rb[keep], ddof=1) * np.sqrt(252)
        truth[f"A{a}"] = (alpha, beta, beta_p, te, np.corrcoef(ra[keep], rb[keep])[0, 1])
    df = spark.createDataFrame(rows, "symbol string, date date, ret double")
    got = {r.symbol: r for r in PF.capm_table(df.where("symbol <> 'B'"), df.where("symbol = 'B'"),
                                              places=None).collect()}
    for k, (alpha, beta, beta_p, te, corr) in truth.items():
        r = got[k]
        assert (r.alpha, r.beta, r.beta_plus, r.tracking_error, r.correlation) == pytest.approx(
            (alpha, beta, beta_p, te, corr), rel=1e-9, abs=1e-12)
