"""Checked queries of the R script's data path: completeness, grid, LOCF,
grid returns, extreme-return screen, reshaping and export."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import date_index
from ..operators import aggregates as agg
from ..operators import prices as px
from ..operators import returns as rt
from ..operators import series as sr
from ..params import W_LONG, W_SHORT
from ..plans.study import stored_study
from ..sources import exports
from .registry import query

WS, WL = W_SHORT, W_LONG
PICKED = ("U1", "U2", "U3", "U10", "U42", "SP500TR")      # a fixed ticker list, as the script's
WIDE = ("L1", "L2", "L3", "SP500TR")


def S(spark, d):
    return stored_study(spark, d, W_SHORT)


def L(spark, d):
    return stored_study(spark, d, W_LONG)


def _picked(spark, names):
    return spark.createDataFrame([(s,) for s in names], "symbol string")


def _in_list(names):
    return ", ".join(f"'{s}'" for s in names)


@query("agg_16_frequency", "SELECT symbol, count(*) AS n FROM eod_r_s GROUP BY symbol")
def agg_16_frequency(spark, d):
    return agg.frequency(S(spark, d).eod_r)


@query("ts_08_complete_symbols", "SELECT * FROM eod_complete_s")
def ts_08_complete_symbols(spark, d):
    return S(spark, d).eod_complete


@query("jon_09_membership", f"SELECT * FROM eod_r_s WHERE symbol IN ({_in_list(PICKED)})")
def jon_09_membership(spark, d):
    return sr.keep_series(S(spark, d).eod_r, F.broadcast(_picked(spark, PICKED)))


@query("agg_18_cell_mean", "SELECT date, symbol, avg(adj_close) AS px FROM eod_complete_s GROUP BY date, symbol")
def agg_18_cell_mean(spark, d):
    return agg.cell_mean(S(spark, d).eod_complete)


@query("ts_04_price_grid", "SELECT * FROM grid_s")
def ts_04_price_grid(spark, d):
    return S(spark, d).grid


@query("ts_05_locf", "SELECT symbol, date, px, price FROM locf_s")
def ts_05_locf(spark, d):
    return S(spark, d).locf


@query("ts_05_locf_long", "SELECT symbol, date, px, price FROM locf_l")
def ts_05_locf_long(spark, d):
    return L(spark, d).locf


@query("win_03_lag_on_grid", """
SELECT symbol, date, px, price, lag(price) OVER (PARTITION BY symbol ORDER BY date) AS prev_price FROM locf_s""")
def win_03_lag_on_grid(spark, d):
    return rt.lagged(S(spark, d).locf, "price")


@query("ret_02_grid_returns", "SELECT * FROM gret_s")
def ret_02_grid_returns(spark, d):
    return S(spark, d).grid_ret


@query("ret_02_grid_returns_long", "SELECT * FROM gret_l")
def ret_02_grid_returns_long(spark, d):
    return L(spark, d).grid_ret


@query("agg_17_column_max", "SELECT * FROM gmax_s")
def agg_17_column_max(spark, d):
    return rt.column_max(S(spark, d).grid_ret)


@query("cln_08_drop_extreme", "SELECT * FROM eod_ret_s")
def cln_08_drop_extreme(spark, d):
    return S(spark, d).eod_ret


@query("cln_08_drop_extreme_long", "SELECT * FROM eod_ret_l")
def cln_08_drop_extreme_long(spark, d):
    return L(spark, d).eod_ret


@query("prj_06_keep_series", f"SELECT * FROM eod_ret_s WHERE symbol IN ({_in_list(PICKED)})")
def prj_06_keep_series(spark, d):
    return S(spark, d).series(PICKED)


@query("prj_07_shape", """
SELECT count(DISTINCT date) AS n_rows, count(DISTINCT symbol) + 1 AS n_cols FROM eod_ret_s""")
def prj_07_shape(spark, d):
    return sr.wide_shape(S(spark, d).eod_ret)


@query("prj_01_head_calendar", f"""
SELECT * FROM calendar WHERE date BETWEEN DATE '{WS.start}' AND DATE '{WS.end}' ORDER BY date LIMIT 10""")
def prj_01_head_calendar(spark, d):
    return sr.peek(px.in_window(S(spark, d).calendar, WS.start, WS.end), 10, ["date"])


@query("prj_01_tail_prices", "SELECT * FROM eod_r_s ORDER BY symbol DESC, date DESC LIMIT 6")
def prj_01_tail_prices(spark, d):
    return sr.peek(S(spark, d).eod_r, 6, ["symbol", "date"], last=True)


@query("srt_04_tail_rows", """
SELECT * FROM eod_ret_l WHERE date IN (SELECT DISTINCT date FROM eod_ret_l ORDER BY date DESC LIMIT 58)""")
def srt_04_tail_rows(spark, d):
    return sr.rows_by_date_position(L(spark, d).eod_ret, 58, "tail")


@query("srt_04_head_drop_last", """
SELECT * FROM eod_ret_l WHERE date NOT IN (SELECT DISTINCT date FROM eod_ret_l ORDER BY date DESC LIMIT 58)""")
def srt_04_head_drop_last(spark, d):
    return sr.rows_by_date_position(L(spark, d).eod_ret, 58, "drop_last")


@query("srt_04_tail_drop_first", """
SELECT symbol, date, price FROM locf_s WHERE date > (SELECT min(date) FROM locf_s)""")
def srt_04_tail_drop_first(spark, d):
    return sr.rows_by_date_position(S(spark, d).locf, 1, "drop_first").select("symbol", "date", "price")


@query("srt_01_ordered_rows", "SELECT * FROM eod_ret_s ORDER BY symbol, date")
def srt_01_ordered_rows(spark, d):
    return S(spark, d).eod_ret.orderBy("symbol", "date")


@query("flt_08_symbol_regex", "SELECT DISTINCT symbol FROM eod_ret_l WHERE regexp_matches(symbol, '^[lL].*')")
def flt_08_symbol_regex(spark, d):
    return sr.symbols_matching(L(spark, d).eod_ret, "^[lL].*")


def _wide_sql(src: str) -> str:
    cols = ", ".join(f"avg(CASE WHEN symbol = '{s}' THEN ret END) AS \"{s}\"" for s in WIDE)
    return f"SELECT date, {cols} FROM {src} GROUP BY date"


@query("ts_03_pivot_wide", _wide_sql("eod_ret_l"))
def ts_03_pivot_wide(spark, d):
    return px.pivot_wide(L(spark, d).eod_ret, WIDE, "ret")


@query("src_19_wide_csv", _wide_sql("eod_ret_l"))
def src_19_wide_csv(spark, d):
    return exports.wide_csv_round_trip(spark, L(spark, d).eod_ret, WIDE)


def _cells_sql(src: str) -> str:
    """Every cell of the whole wide table, empty ones as NULL."""
    return f"""
    SELECT d.date, s.symbol, r.ret
    FROM (SELECT DISTINCT date FROM {src}) d CROSS JOIN (SELECT DISTINCT symbol FROM {src}) s
    LEFT JOIN (SELECT date, symbol, avg(ret) AS ret FROM {src} GROUP BY date, symbol) r
      ON r.date = d.date AND r.symbol = s.symbol"""


@query("ts_03_wide_all_series", _cells_sql("eod_ret_l"))
def ts_03_wide_all_series(spark, d):
    return px.wide_cells(L(spark, d).eod_ret, "ret")


@query("src_19_wide_csv_all_series", _cells_sql("eod_ret_l"))
def src_19_wide_csv_all_series(spark, d):
    return exports.wide_csv_all_series(spark, L(spark, d).eod_ret)


@query("scl_09_date_index", """
SELECT DISTINCT strftime(date, '%Y-%m-%d') AS row_name, CAST(strftime(date, '%Y-%m-%d') AS DATE) AS date
FROM eod_ret_s""")
def scl_09_date_index(spark, d):
    names = S(spark, d).eod_ret.select(F.date_format("date", "yyyy-MM-dd").alias("row_name")).distinct()
    return names.select("row_name", date_index(F.col("row_name")).alias("date"))


@query("ts_09_align_benchmark", f"""
SELECT a.symbol, a.date, a.ret, b.ret AS ret_b FROM eod_ret_l a
JOIN (SELECT date, ret FROM eod_ret_l WHERE symbol = 'SP500TR') b ON a.date = b.date
WHERE a.symbol IN ({_in_list(WIDE[:3])})""")
def ts_09_align_benchmark(spark, d):
    st = L(spark, d)
    assets = st.series(WIDE[:3])
    bench = st.eod_ret.where(F.col("symbol") == "SP500TR")
    return px.align_on_date(assets, bench)


@query("ret_03_monthly_grid_returns", "SELECT * FROM eod_ret_lm")
def ret_03_monthly_grid_returns(spark, d):
    return L(spark, d).eom_ret


@query("ts_07_monthly_completeness_r", "SELECT symbol, pct FROM pct_lm")
def ts_07_monthly_completeness_r(spark, d):
    return L(spark, d).pct_monthly


@query("ts_07_monthly_pivot", _wide_sql("eod_ret_lm"))
def ts_07_monthly_pivot(spark, d):
    return px.pivot_wide(L(spark, d).eom_ret, WIDE, "ret")


@query("ts_07_monthly_wide_all_series", _cells_sql("eod_ret_lm"))
def ts_07_monthly_wide_all_series(spark, d):
    return px.wide_cells(L(spark, d).eom_ret, "ret")
