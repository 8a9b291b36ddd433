import collections
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quotecraft.operators import profiles as pf


@pytest.fixture(scope="module")
def dated(spark):
    """Rows of 30 keys over 400 days around day 0, some days twice or more, some rows without a date."""
    rng = random.Random(17)
    rows = [(f"S{k}", pf.ORIGIN + dt.timedelta(days=rng.randrange(-200, 200))) for k in range(30) for _ in range(rng.randrange(1, 300))]
    rows += [("S0", dt.date(1970, 1, 1))] * 5 + [("S1", None), (None, dt.date(1970, 1, 2))]
    return rows, spark.createDataFrame(rows, "ticker string, date date")


@pytest.mark.parametrize("start, end", [
    ("1969-07-01", "1970-07-30"), ("1970-01-01", "1970-01-01"), ("1969-12-31", "1970-03-05"), ("1970-03-06", "1970-03-06"),
    ("1969-10-29", "1969-12-31"), ("1990-01-01", "1991-01-01")])
def test_windows_are_counted_from_profiles(spark, dated, start, end):
    rows, df = dated
    a, b = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    want = collections.Counter(t for t, d in rows if d is not None and a <= d <= b)
    got = {r.ticker: round(r.complete * 1000) for r in pf.completeness_of(
        pf.day_profiles(df, "ticker"), "ticker", start, end, F.lit(1000), real=False).collect()}
    assert got == dict(want)


def test_profiles_of_two_tables_merge(spark, dated):
    rows, df = dated
    early, late = df.where("date < DATE '1970-01-01'"), df.where("date >= DATE '1970-01-01'")
    both = pf.merge_profiles(pf.day_profiles(early, "ticker"), pf.day_profiles(late, "ticker"), key="ticker")
    count = lambda p: sorted((r.ticker or "", r.n) for r in p.groupBy("ticker").agg(
        F.sum(pf.rows_in("1969-01-01", "1971-01-01")).alias("n")).collect())
    assert count(both) == count(pf.day_profiles(df, "ticker"))
    assert pf.day_profiles(df.limit(0), "ticker").count() == 0
