"""The company-side queries of the review script: joins, semi/anti joins,
set operations, pattern filters, sorts with NULL order (JON-01/04..09,
SET-01/03/04, FLT-01/03/04/05/07/08, SRT-02/03, AGG-04/05/07..12).

Joins are left to Spark's planner except where a side has a proven bound:
the company list grows with the listing universe, so no broadcast is forced
on it; AQE converts a join to broadcast at run time when a side turns out
small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUOTE_COLUMNS = ["ticker", "date", "company_name", "market_cap", "country", "adj_open", "adj_high",
                 "adj_low", "adj_close", "adj_volume"]


def null_sector_quotes(companies: DataFrame, quotes: DataFrame, market: str = "NASDAQ") -> DataFrame:
    """JON-01: quotes of the market's companies with a NULL sector (inner join)."""
    c = companies.where(F.col("sector").isNull() & (F.col("stock_mkt_name") == market))
    return c.join(quotes, F.col("symbol") == F.col("ticker")).select(*QUOTE_COLUMNS)


def on_markets(companies: DataFrame, column: str, markets: Sequence[str],
               out: Sequence[str]) -> DataFrame:
    """JON-08: rows of the first market whose ``column`` value is also listed
    on every other market -- ``IN (subquery)`` chained as left semi joins.
    ``IN`` never matches NULL, so NULL values drop out."""
    first, *rest = markets
    base = companies.where(F.col("stock_mkt_name") == first)
    for m in rest:
        other = companies.where(F.col("stock_mkt_name") == m).select(F.col(column).alias("_v"))
        base = base.join(other, F.col(column) == F.col("_v"), "left_semi")
    return base.select(*out)


def distinct_markets_at_least(companies: DataFrame, keys: Sequence[str], n: int,
                              exact: bool = False) -> DataFrame:
    """AGG-04: groups listed on more than / exactly n markets (``HAVING COUNT(DISTINCT)``).

    GROUP BY keeps a NULL group."""
    cnt = F.countDistinct("stock_mkt_name")
    groups = companies.groupBy(*keys).agg(cnt.alias("_n"))
    return groups.where((F.col("_n") == n) if exact else (F.col("_n") > n)).select(*keys)


def missing_from(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """SET-04 / JON-04..06: distinct left keys with no right row (left anti join)."""
    r = right.select(F.col(right_key).alias("_r"))
    return left.select(left_key).join(r, F.col(left_key) == F.col("_r"), "left_anti").distinct()


def match_flag(left: DataFrame, right: DataFrame, keys: list[str], out: str) -> DataFrame:
    """JON-10: every row of ``left`` once, with 1 in ``out`` where ``right`` holds its keys and 0 elsewhere.

    NULL keys match nothing, as in any join."""
    hits = right.select(*keys).distinct().withColumn(out, F.lit(1))
    return left.join(hits, keys, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def missing_by_outer_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """JON-04: the outer-join form -- LEFT JOIN ... WHERE right key IS NULL."""
    r = right.select(F.col(right_key).alias("_r")).distinct()
    return (left.join(r, F.col(left_key) == F.col("_r"), "left")
            .where(F.col("_r").isNull()).select(left_key).distinct())


def missing_by_right_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                          out: str) -> DataFrame:
    """JON-06: ``left RIGHT JOIN right ... WHERE left key IS NULL``: right keys without a left row."""
    l = left.select(F.col(left_key).alias("_l")).distinct()
    return (l.join(right.select(right_key), F.col("_l") == F.col(right_key), "right")
            .where(F.col("_l").isNull()).select(F.col(right_key).alias(out)).distinct())


def not_in(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """JON-05: ``WHERE key NOT IN (SELECT DISTINCT ...)`` with SQL's NULL rule.

    If the subquery holds a NULL the predicate is never true and the result is
    empty; a NULL left key never qualifies.  Without NULLs this is a left anti
    join, which is what Spark plans for the non-null case.
    """
    r = right.select(F.col(right_key).alias("_r")).distinct()
    null_in_list = r.where(F.col("_r").isNull()).exists()
    anti = left.where(F.col(left_key).isNotNull()).join(
        r.where(F.col("_r").isNotNull()), F.col(left_key) == F.col("_r"), "left_anti")
    return anti.where(~null_in_list)


def all_keys_union(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """SET-01: ``SELECT DISTINCT a UNION SELECT DISTINCT b`` -- each side is
    de-duplicated before the union (partial aggregation), then once more."""
    a = left.select(F.col(left_key).alias(left_key)).distinct()
    b = right.select(F.col(right_key).alias(left_key)).distinct()
    return a.union(b).distinct()


def all_keys_full_outer(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                        out: str = "tck") -> DataFrame:
    """JON-07: FULL OUTER JOIN with key coalescing.

    The reference joins the full quotes table ("takes too long"); both sides
    are reduced to distinct keys first, which gives the same result and
    shuffles keys, not rows.
    """
    a = left.select(F.col(left_key).alias("_a")).distinct()
    b = right.select(F.col(right_key).alias("_b")).distinct()
    return a.join(b, F.col("_a") == F.col("_b"), "full_outer").select(F.coalesce("_b", "_a").alias(out)).distinct()


def intersect_markets(companies: DataFrame, column: str, markets: Sequence[str]) -> DataFrame:
    """SET-03: values present on every listed market, by INTERSECT (distinct)."""
    parts = [companies.where(F.col("stock_mkt_name") == m).select(column) for m in markets]
    out = parts[0]
    for p in parts[1:]:
        out = out.intersect(p)
    return out


def first_listed(quotes: DataFrame) -> DataFrame:
    """AGG-08 / JON-14: DISTINCT (ticker, date) on the table's earliest date."""
    first = quotes.agg(F.min("date")).scalar()
    return quotes.where(F.col("date") == first).select("ticker", "date").distinct()


def date_range_per_ticker(quotes: DataFrame) -> DataFrame:
    """AGG-07: (ticker, first_date, last_date)."""
    return quotes.groupBy("ticker").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def last_listed(quotes: DataFrame) -> DataFrame:
    """AGG-09: tickers whose first date is the latest first date (max of per-group min)."""
    rng = date_range_per_ticker(quotes)
    latest = rng.agg(F.max("first_date")).scalar()
    return rng.where(F.col("first_date") == latest)


def name_like(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """FLT-04/05: DISTINCT values matching a case-sensitive LIKE pattern."""
    return df.where(F.col(column).like(pattern)).select(column).distinct()


def bottom_k(df: DataFrame, column: str, k: int, tie_break: Sequence[str]) -> DataFrame:
    """SRT-02: ``ORDER BY c LIMIT k`` with PostgreSQL's NULLS LAST; ties broken
    by ``tie_break`` so the row set is deterministic.  Spark plans a
    TakeOrderedAndProject: a per-partition top-k, then one merge of k rows."""
    return df.orderBy(F.col(column).asc_nulls_last(), *[F.col(c).asc() for c in tie_break]).limit(k)


def order_desc_nulls_first(df: DataFrame, column: str, *more: Column) -> DataFrame:
    """SRT-03: ``ORDER BY c DESC`` as PostgreSQL sorts it (NULLs first)."""
    return df.orderBy(F.col(column).desc_nulls_first(), *more)
