"""Integrity checks and cleaning: DQ-01..04, CLN-01..03.

Checks return *violation* DataFrames (empty = the constraint holds), which is
how declared constraints are enforced on files: Spark does not enforce
PRIMARY KEY / FOREIGN KEY on parquet tables.  Each check is one scan plus at
most one aggregation or anti join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def pk_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """DQ-01: key values held by more than one row, with their row count.

    A NULL key part is a violation too (a primary key is NOT NULL).
    """
    keys = list(keys)
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(
        (F.col("n_rows") > 1) | F.greatest(*[F.col(k).isNull() for k in keys] + [F.lit(False)]))
    return dup


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """DQ-02: (column_name, null_count) for every column, in one scan."""
    columns = list(columns or df.columns)
    row = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return row.selectExpr(f"stack({len(columns)}, {pairs}) AS (column_name, null_count)")


def not_null_violations(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """DQ-02: (column_name, *keys) for each NULL in a NOT NULL column."""
    bad = violations([(F.col(c).isNull(), F.struct(F.lit(c).alias("column_name"))) for c in columns])
    return df.select(*keys, F.explode(bad).alias("_v")).select("_v.column_name", *keys)


def violations(checks: Sequence[tuple[Column, Column]]) -> Column:
    """An array of the structs whose condition holds: exploded, all checks of a row in one scan."""
    return F.array_compact(F.array(*[F.when(bad, what) for bad, what in checks]))


def fk_orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """DQ-03: child rows whose key has no parent (NULL keys are not orphans)."""
    par = parent.select(F.col(parent_key).alias("_pk")).distinct()
    return child.where(F.col(child_key).isNotNull()).join(
        par, F.col(child_key) == F.col("_pk"), "left_anti")


def length_report(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """DQ-04: (column_name, max_length, max_allowed, n_over) in one scan."""
    aggs = []
    for c, lim in limits.items():
        aggs += [F.max(F.length(c)).alias(f"{c}__max"),
                 F.count(F.when(F.length(c) > lim, 1)).alias(f"{c}__over")]
    row = df.agg(*aggs)
    parts = ", ".join(f"'{c}', `{c}__max`, {lim}, `{c}__over`" for c, lim in limits.items())
    return row.selectExpr(f"stack({len(limits)}, {parts}) AS (column_name, max_length, max_allowed, n_over)") \
        .select("column_name", F.col("max_length").cast("int").alias("max_length"),
                F.col("max_allowed").cast("int").alias("max_allowed"),
                F.col("n_over").cast("bigint").alias("n_over"))


def length_violations(df: DataFrame, limits: dict[str, int], keys: Sequence[str]) -> DataFrame:
    """DQ-04: (column_name, *keys, length) for each value over its limit."""
    bad = violations([(F.length(c) > lim, F.struct(F.lit(c).alias("column_name"), F.length(c).alias("length")))
                      for c, lim in limits.items()])
    return df.select(*keys, F.explode(bad).alias("_v")).select("_v.column_name", *keys, "_v.length")


def zero_to_null(df: DataFrame, column: str) -> DataFrame:
    """CLN-01: ``UPDATE ... SET c = NULL WHERE c = 0``."""
    return df.withColumn(column, F.when(F.col(column) == 0, F.lit(None)).otherwise(F.col(column)))


def trim_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """CLN-02: TRIM of blanks on each listed column (one projection)."""
    cols = set(columns)
    return df.select(*[F.trim(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def cast_strict(df: DataFrame, casts: dict[str, str]) -> DataFrame:
    """CLN-03 strict: ANSI ``cast``; a bad value fails the job, as ``::`` does."""
    return df.select(*[F.col(c).cast(casts[c]).alias(c) if c in casts else F.col(c) for c in df.columns])


def cast_lenient(df: DataFrame, casts: dict[str, str], keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """CLN-03 lenient: ``try_cast``; returns (typed rows, rejects).

    Rejects are (*keys, column_name, value) for each non-NULL text that did
    not convert; typed rows carry NULL there.
    """
    typed = df.select(*[F.expr(f"try_cast(`{c}` AS {casts[c]})").alias(c) if c in casts else F.col(c)
                        for c in df.columns])
    bad = violations([(_rejected(c, t), F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")))
                      for c, t in casts.items()])
    return typed, df.select(*keys, F.explode(bad).alias("_v")).select(*keys, "_v.column_name", "_v.value")


def _rejected(column: str, kind: str) -> Column:
    return F.col(column).isNotNull() & F.expr(f"try_cast(`{column}` AS {kind})").isNull()


def observed(df: DataFrame, required: Sequence[str] = (), limits: dict[str, int] | None = None,
             casts: dict[str, str] | None = None) -> tuple[DataFrame, Observation]:
    """``df`` with counters that the next action on it fills, in its own scan: DQ-02, DQ-04 and CLN-03
    while a load is written.  ``load_report`` reads them.

    Metrics: n_rows, and per column its NULLs (``required``), values over their length
    (``limits``) and texts that do not convert (``casts``)."""
    count = lambda bad: F.count(F.when(bad, 1))
    metrics = [F.count(F.lit(1)).alias("n_rows")]
    metrics += [count(F.col(c).isNull()).alias(f"null:{c}") for c in required]
    metrics += [count(F.length(c) > lim).alias(f"long:{c}") for c, lim in (limits or {}).items()]
    metrics += [count(_rejected(c, t)).alias(f"cast:{c}") for c, t in (casts or {}).items()]
    seen = Observation()
    return df.observe(seen, *metrics), seen


def load_report(df: DataFrame, seen: Observation) -> DataFrame:
    """(check_name, column_name, n) of an :func:`observed` load, after its action."""
    rows = [(*(k.split(":", 1) if ":" in k else (k, "")), int(v)) for k, v in seen.get.items()]
    return df.sparkSession.createDataFrame(rows, "check_name string, column_name string, n long")
