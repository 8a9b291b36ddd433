"""Registry of checked queries: name -> (Spark callable, DuckDB oracle text).

Each Spark callable takes ``(spark, sf_dir)`` and returns a DataFrame built by
the operator its name carries; the oracle is independent SQL over the same
driver tables (``sqlbase`` CTEs).  Computed doubles are rounded to a fixed
number of places in both engines (``round(x, k) + 0.0``) where summation
order can move the last bits; prices and strict returns are compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sqlbase import with_ctes

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def query(name: str, sql: str | None = None, extra_ctes: dict[str, str] | None = None):
    """Register ``fn`` under ``name`` with its oracle body (CTEs resolved)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, with_ctes(sql, extra_ctes) if sql else None)
        return fn
    return deco


def rnd(c: Column | str, k: int = 6) -> Column:
    """Spark side of the comparison rounding: ``round(x, k) + 0.0``."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, k) + F.lit(0.0)


def rnd_many(c: Column | str, k: int) -> Column:
    """:func:`rnd` for very many values, the same results: Spark's own rounding writes each value
    out in decimal digits, so only values next to a tie, or large ones, go there."""
    x = F.col(c) if isinstance(c, str) else c
    y = F.abs(x) * F.lit(10.0 ** k)
    # below 1e11 the product is exact to 1e-5, and whole / 10^k is the double next to the rounded decimal
    plain = (y < 1e11) & (F.abs(y - F.floor(y) - 0.5) > 1e-4)
    return F.when(plain, F.signum(x) * (F.floor(y + 0.5) / F.lit(10.0 ** k))).otherwise(F.round(x, k)) + F.lit(0.0)


def r_sql(expr: str, k: int = 6) -> str:
    """SQL side of the comparison rounding."""
    return f"(round(({expr}), {k}) + 0.0)"


def rnd_sig(c: Column | str, digits: int = 8) -> Column:
    """Spark side of rounding to significant digits (values that compound)."""
    x = F.col(c) if isinstance(c, str) else c
    scale = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x / scale, digits - 1) * scale) + F.lit(0.0)


def r_sig_sql(expr: str, digits: int = 8) -> str:
    """SQL side of :func:`rnd_sig`."""
    e = f"({expr})"
    scale = f"power(10.0, floor(log10(abs({e}))))"
    return f"(CASE WHEN {e} = 0 THEN 0.0 ELSE round({e} / {scale}, {digits - 1}) * {scale} END + 0.0)"
