"""Stored studies: registered queries read tables instead of nesting the first pass."""

import re

from quotecraft.params import W_LONG, W_SHORT
from quotecraft.plans.study import Study, stored_study
from quotecraft.queries import queries

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_stored_views_equal_the_lazy_ones(spark):
    lazy, kept = Study(spark, SF, W_SHORT), stored_study(spark, SF, W_SHORT)
    for name in ("mv_eod", "mv_ret", "exclusions", "eod_ret"):
        a, b = getattr(lazy, name), getattr(kept, name).select(*getattr(lazy, name).columns)
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_a_study_is_stored_once_per_session(spark):
    a = stored_study(spark, SF, W_LONG)
    assert a is stored_study(spark, SF, W_LONG)
    assert a.eod_ret is a.eod_ret_stored
    assert a.quotes is stored_study(spark, SF, W_SHORT).quotes


def test_plans_start_from_stored_tables(spark):
    qs = queries()
    for name in ("ret_01_strict_returns_long", "jon_11_calendar_left_join", "jon_03_prev_price_join",
                 "ret_08_capm_table", "ret_11_boxplot_stats"):
        df = qs[name](spark, SF)
        text = _plan(df)
        assert not re.search(r"lineitem|events", " ".join(df.inputFiles()))
        assert "Cartesian" not in text and text.count("Relation [") <= 10
        assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
