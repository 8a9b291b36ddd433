"""Check jobs with known counts: the fixture facts measured independently
(SURVEY §5.3) must come out of the operators unchanged."""

import pytest
from pyspark.sql import functions as F

from quotecraft.operators import prices as P
from quotecraft.operators import returns as R
from quotecraft.params import W_LONG, W_SHORT
from quotecraft.plans.study import Study

FACTS = {
    "short": dict(days=33, trading=22, symbols=151, strict=2262, over_limit=33, grid=1804, filled=118,
                  missing=135, p99=12, p95=28, p_thr=82),
    "long": dict(days=2500, trading=1771, symbols=33, strict=29671, over_limit=2, grid=37191, filled=6129,
                 missing=644, p99=1, p95=8, p_thr=21),
}


@pytest.mark.parametrize("w", [W_SHORT, W_LONG], ids=["short", "long"])
def test_window_facts(spark, w):
    f = FACTS[w.name]
    st = Study(spark, "/root/testdata/sf0.01", w)
    cal = P.in_window(st.calendar, w.start, w.end)
    assert cal.count() == f["days"] and cal.where("trading = 1").count() == f["trading"]
    assert st.eod_r.select("symbol").distinct().count() == f["symbols"]
    strict = R.strict_returns(st.eod_r, st.calendar)
    assert strict.count() == f["strict"]
    assert strict.where("ret > 1.0").select("symbol").distinct().count() == f["over_limit"]
    g = st.locf
    assert g.count() == f["grid"]
    assert g.where("px IS NULL AND price IS NOT NULL").count() == f["filled"]
    assert g.where("price IS NULL").count() == f["missing"]
    pct = st.pct
    assert pct.where("pct >= 0.99").count() == f["p99"]
    assert pct.where("pct >= 0.95").count() == f["p95"]
    assert pct.where(F.col("pct") >= w.threshold).count() == f["p_thr"]


def test_company_facts(spark):
    st = Study(spark, "/root/testdata/sf0.01")
    per = st.staging.groupBy("symbol").count()
    assert {r["count"]: r["n"] for r in per.groupBy("count").agg(F.count(F.lit(1)).alias("n")).collect()} \
        == {1: 1158, 2: 85, 3: 43}
    ns = st.nasdaq_null_sector
    assert ns.count() == 260 and ns.select("ticker").distinct().count() == 15
    assert ns.where("country IS NOT NULL").select("country").distinct().count() == 7
