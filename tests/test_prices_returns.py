import datetime as dt

import pytest
from pyspark.sql import functions as F

from quotecraft.operators import calendar as C
from quotecraft.operators import prices as P
from quotecraft.operators import returns as R

D = dt.date


def _grid(spark, values):
    rows = [("s", D(2024, 1, 1) + dt.timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, date date, px double")


@pytest.mark.parametrize("run", [0, 1, 2, 3, 4, 5])
def test_locf_fills_only_short_runs(spark, run):
    vals = [1.0] + [None] * run + [2.0]
    out = [r.price for r in P.locf(_grid(spark, vals), maxgap=3).orderBy("date").collect()]
    if run <= 3:
        assert out == [1.0] + [1.0] * run + [2.0]
    else:
        assert out == [1.0] + [None] * run + [2.0]


def test_locf_leading_and_trailing(spark):
    out = [r.price for r in P.locf(_grid(spark, [None, None, 3.0, None, None]), 3).orderBy("date").collect()]
    assert out == [None, None, 3.0, 3.0, 3.0]
    allnull = [r.price for r in P.locf(_grid(spark, [None, None]), 3).collect()]
    assert allnull == [None, None]


def test_grid_returns_and_minus_one(spark):
    g = _grid(spark, [1.0, 2.0, None, 0.0]).withColumnRenamed("px", "price")
    out = [r.ret for r in R.grid_returns(g).orderBy("date").collect()]
    assert out == [1.0, None, None]


def test_drop_extreme_keeps_all_missing(spark):
    ret = spark.createDataFrame([("a", D(2024, 1, 1), 0.5), ("b", D(2024, 1, 1), 1.5),
                                 ("c", D(2024, 1, 1), None)], "symbol string, date date, ret double")
    kept = {r.symbol for r in R.drop_extreme_series(ret).collect()}
    assert kept == {"a", "c"}


def test_strict_returns_window_equals_self_join(spark):
    cal = C.enrich_calendar(C.trading_calendar(spark, "2023-12-27", "2024-01-12"))
    rows = [("a", D(2023, 12, 28), 10.0), ("a", D(2023, 12, 29), 11.0),
            ("a", D(2024, 1, 1), 99.0),          # holiday quote: gets a return, is not a previous price
            ("a", D(2024, 1, 2), 12.0), ("a", D(2024, 1, 4), 13.0),   # Jan 3 missing -> no return Jan 4
            ("a", D(2024, 1, 5), 14.0), ("b", D(2024, 1, 5), 5.0)]
    eod = spark.createDataFrame(rows, "symbol string, date date, adj_close float")
    w = {(r.symbol, r.date): r.ret for r in R.strict_returns(eod, cal).collect()}
    j = {(r.symbol, r.date): r.ret for r in R.strict_returns_join(eod, cal).collect()}
    assert w == j
    assert ("a", D(2024, 1, 4)) not in w
    assert w[("a", D(2024, 1, 2))] == pytest.approx(12 / 11 - 1, rel=1e-6)
    assert ("a", D(2024, 1, 1)) in w


def test_float32_quotient(spark):
    df = spark.createDataFrame([(1.1, 3.3)], "a float, b float")
    v = df.select(R.real_ratio_minus_one(F.col("b"), F.col("a")).alias("r")).first().r
    import numpy as np
    assert v == float(np.float32(np.float32(3.3) / np.float32(1.1))) - 1.0


def test_union_distinct_positional(spark):
    a = spark.createDataFrame([("x", 1)], "symbol string, v int")
    b = spark.createDataFrame([("x", 1), ("y", 2)], "ticker string, v int")
    out = P.union_distinct(a, b)
    assert out.columns == ["symbol", "v"] and out.count() == 2


def test_price_grid_no_cross_join(spark):
    cal = C.trading_calendar(spark, "2024-01-01", "2024-01-10")
    eod = spark.createDataFrame([("a", D(2024, 1, 2), 1.0), ("a", D(2024, 1, 2), 3.0),
                                 ("b", D(2024, 1, 3), 2.0)], "symbol string, date date, adj_close double")
    g = P.price_grid(eod, cal, "2024-01-01", "2024-01-10")
    assert g.count() == 2 * 7                           # 7 trading days x 2 symbols
    assert g.where("symbol = 'a' AND date = DATE'2024-01-02'").first().px == 2.0
    assert "CartesianProduct" not in g._jdf.queryExecution().executedPlan().toString()


def test_wide_blocks_hold_every_series(spark):
    """Blocks of two columns: all dates in each, no cell lost, odd names, repeated cells averaged."""
    days = [D(2024, 1, k) for k in (2, 3, 4)]
    rows = [("a", days[0], 1.0), ("a", days[0], 3.0), ("b.c", days[1], 2.0), ("d`e", days[2], None), ("f", days[2], 4.0),
            ("g", days[0], 5.0), (None, days[1], 9.0)]
    long = spark.createDataFrame(rows, "symbol string, date date, ret double")
    blocks = P.wide_blocks(long, "ret", block=2)
    assert [b.columns[1:] for b in blocks] == [["a", "b.c"], ["d`e", "f"], ["g"]]
    assert [b.count() for b in blocks] == [3, 3, 3]
    want = {(d, s): None for d in days for s in ("a", "b.c", "d`e", "f", "g")}
    want |= {(days[0], "a"): 2.0, (days[1], "b.c"): 2.0, (days[2], "f"): 4.0, (days[0], "g"): 5.0}
    cells = [r for b in blocks for r in P.wide_to_long(b, "ret").collect()]
    assert len(cells) == len(want) and {(r.date, r.symbol): r.ret for r in cells} == want
    assert P.wide_blocks(long.limit(0), "ret") == []
    assert P.wide_cells(long.limit(0), "ret").count() == 0
