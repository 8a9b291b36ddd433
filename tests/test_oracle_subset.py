"""A cross-section of the registered queries against their DuckDB oracle at sf0.01."""

import math

import pytest

from quotecraft.queries import oracle_sql, queries

SF = "/root/testdata/sf0.01"
SUBSET = ["ts_02_calendar_enriched", "jon_13_asof_prev_trading_day", "cln_04_exclusions_missing",
          "ret_01_strict_returns", "src_14_refresh_returns", "agg_06_sector_summary",
          "jon_08_countries_on_all_markets", "agg_04_countries_three_markets", "ts_05_locf",
          "cln_08_drop_extreme", "ret_04_stats_table", "ret_08_capm_table", "ret_11_boxplot_stats",
          "ptf_04_min_variance_weights", "ptf_07_portfolio_returns"]


def _canon(rows):
    def norm(v):
        if isinstance(v, float) and math.isnan(v):
            return None
        return v
    return sorted((tuple(norm(x) for x in r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_every_query_has_a_callable():
    q, s = queries(), oracle_sql()
    assert len(q) >= 150 and set(s) <= set(q)


@pytest.mark.parametrize("name", SUBSET)
def test_against_oracle(spark, duck, name):
    df = queries()[name](spark, SF)
    cols = df.columns
    srows = [tuple(r) for r in df.collect()]
    res = duck.execute(oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(cols) == sorted(ocols)
    a = _canon([tuple(r[cols.index(c)] for c in sorted(cols)) for r in srows])
    b = _canon([tuple(r[ocols.index(c)] for c in sorted(ocols)) for r in orows])
    assert a == b
