import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quotecraft.operators import calendar as C
from quotecraft.sources.fixtures import fixture_calendar

D = dt.date


def test_fixed_range_calendar(spark):
    cal = C.trading_calendar(spark, "2024-12-20", "2025-01-06").orderBy("date").collect()
    by = {r.date: r for r in cal}
    assert by[D(2024, 12, 25)].trading == 0          # fixed holiday
    assert by[D(2024, 12, 28)].dow == "Sat" and by[D(2024, 12, 28)].trading == 0
    assert by[D(2025, 1, 1)].trading == 0
    assert by[D(2025, 1, 2)].trading == 1 and by[D(2025, 1, 2)].dow == "Thu"


def test_holiday_table(spark):
    hol = spark.createDataFrame([(D(2025, 1, 3),)], "date date")
    cal = C.trading_calendar(spark, "2025-01-01", "2025-01-06", holiday_dates=hol)
    assert {r.date for r in cal.where("trading = 0").collect()} >= {D(2025, 1, 3)}


def test_enrichment_matches_join_forms(spark):
    cal = C.trading_calendar(spark, "2023-12-20", "2024-02-05")
    enr = C.enrich_calendar(cal)
    asof = C.prev_trading_day_asof(cal)
    eom_join = C.month_end_flags(cal)
    a = {r.date: r.prev_trading_day for r in enr.collect()}
    b = {r.date: r.ptd for r in asof.collect()}
    assert a == b                                      # JON-13 == WIN-01
    e1 = {r.date: r.eom for r in enr.collect()}
    e2 = {r.date: r.endofm for r in eom_join.collect()}
    assert e1 == e2                                    # JON-10 == WIN-02
    assert a[D(2024, 1, 2)] == D(2023, 12, 29)         # over New Year
    assert e1[D(2023, 12, 29)] == 1 and e1[D(2024, 1, 31)] == 1


def test_asof_backward_by_key(spark):
    left = spark.createDataFrame([("a", 5), ("a", 10), ("b", 10), ("b", 1)], "k string, t int")
    right = spark.createDataFrame([("a", 5, 50), ("a", 7, 70), ("b", 2, 20)], "k string, rt int, v int")
    strict = {(r.k, r.t): r.v for r in C.asof_backward(left, right, "t", "rt", "v", "v", by=["k"]).collect()}
    assert strict == {("a", 5): None, ("a", 10): 70, ("b", 10): 20, ("b", 1): None}
    loose = {(r.k, r.t): r.v for r in
             C.asof_backward(left, right, "t", "rt", "v", "v", by=["k"], strict=False).collect()}
    assert loose[("a", 5)] == 50


@pytest.mark.parametrize("strict", [True, False])
def test_asof_backward_without_groups(spark, strict):
    """Against brute force over many ranges: hot keys, ties, nulls, no match."""
    rng = random.Random(7)
    left = [(i, rng.choice([None, 500, *range(0, 1000, 3)])) for i in range(600)] + [(1000 + i, 500) for i in range(300)]
    right = [(rng.choice([500, *range(-5, 990, 7)]), rng.choice([None, *range(50)])) for _ in range(400)] + [(None, 99)]
    a = spark.createDataFrame(left, "id int, t int").repartition(8)
    b = spark.createDataFrame(right, "rt int, v int").repartition(8)
    got = {r.id: r.v for r in C.asof_backward(a, b, "t", "rt", "v", "v", strict=strict).collect()}
    held = [(k, v) for k, v in right if k is not None and v is not None]
    want = {i: max(((k, v) for k, v in held if t is not None and (k < t or (k == t and not strict))),
                   default=(0, None))[1] for i, t in left}
    assert got == want


def test_asof_backward_empty_sides(spark):
    a, b = spark.createDataFrame([(1,)], "t int"), spark.createDataFrame([(0, 5)], "rt int, v int")
    assert C.asof_backward(a.limit(0), b, "t", "rt", "v", "v").collect() == []
    assert [tuple(r) for r in C.asof_backward(a, b.limit(0), "t", "rt", "v", "v").collect()] == [(1, None)]


def test_update_from_keeps_unmatched(spark):
    t = spark.createDataFrame([(1, "x"), (2, "y")], "id int, c string")
    s = spark.createDataFrame([(2, None)], "id int, c string")
    out = {r.id: r.c for r in C.update_from(t, s, "id", ["c"]).collect()}
    assert out == {1: "x", 2: None}


def test_fixture_calendar_counts(spark):
    cal = fixture_calendar(spark, "/root/testdata/sf0.01")
    assert cal.count() == 10624
    first = cal.orderBy("date").first()
    assert first.date == D(1994, 12, 30) and first.trading == 1
    assert cal.where(F.col("trading") == 1).count() == 7525
