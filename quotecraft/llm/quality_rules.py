"""Quality rules with adaptive thresholds per language and source.

Fixed cutoffs are replaced by outlier fences read from quantile sketches.  A
sketch is the table of (bucket, count) of one measure in one group, with
integer buckets of a fixed width: two sketches merge by adding counts, so
Spark's partial aggregation builds them before any shuffle, a hot group costs
one row per bucket and task, and every run gives the same thresholds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store
from .text_metrics import text_metrics

#: measure -> (numerator, denominator, least fence): shares in thousandths
#: (``word_len``: thousandths of a character).  The least fence keeps a group
#: whose quartiles coincide from rejecting everything above its median.
MEASURES = {
    "symbol_share": ("n_symbols", "word_chars", 30),
    "dup_line_share": ("n_dup_lines", "n_lines", 400),
    "repeat_share": ("n_repeat_words", "n_words", 450),
    "upper_share": ("n_upper", "word_chars", 300),
    "mark_share": ("n_marks", "word_chars", 60),
}
#: bucket width in thousandths
WIDTH = 5
#: groups with fewer documents take the thresholds of their language, languages
#: with fewer those of all documents
LEAST_GROUP = 40
#: fence = upper quartile + FENCE * (upper quartile - median), at least the least fence
FENCE = 6
#: a ceiling is taken from the sources of a language, or else of the corpus, if they are at least so many
LEAST_SOURCES = 3
#: weight of one source in a ceiling's sketch
VOTE = 1_000_000


def share(num: str, den: str) -> Column:
    """Whole thousandths of ``num / den``; 0 where ``den`` is 0."""
    return F.when(F.col(den) > 0, F.expr(f"(1000 * {num}) div {den}")).otherwise(F.lit(0)).cast("long")


def sketches(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, bucket, n): one mergeable quantile sketch per group and measure."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), (F.expr(f"`{m}` div {WIDTH}")).alias("bucket"))
                                for m in MEASURES])).alias("p")
    return (metrics.select(*keys, pairs).groupBy(*keys, "p.measure", "p.bucket")
            .agg(F.count(F.lit(1)).alias("n")))


def merge(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Merge sketches to coarser groups by adding their counts."""
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, total, fence in thousandths) of each sketch.

    A quantile is the upper edge of the first bucket at which the running
    count reaches its share of the total.
    """
    w = Window.partitionBy(*keys, "measure")
    run = sketch.select(*keys, "measure", "bucket", F.sum("n").over(w).alias("total"),
                        F.sum("n").over(w.orderBy("bucket")).alias("upto"))
    edge = (F.col("bucket") + 1) * WIDTH
    q = run.groupBy(*keys, "measure").agg(
        F.max("total").alias("total"),
        F.min(F.when(2 * F.col("upto") >= F.col("total"), edge)).alias("q50"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("total"), edge)).alias("q75"))
    least = F.element_at(F.create_map(*[x for m, (_, _, f) in MEASURES.items() for x in (F.lit(m), F.lit(f))]),
                         F.col("measure"))
    return q.select(*keys, "measure", "total",
                    F.greatest(F.col("q75") + FENCE * (F.col("q75") - F.col("q50")), least).cast("long").alias("fence"))


def ceilings(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, ceiling): the fence of sketches in which every (lang,
    source) group of at least ``LEAST_GROUP`` documents weighs the same, so a
    large group cannot lift it; only where ``LEAST_SOURCES`` groups vote."""
    group = Window.partitionBy("lang", "source", "measure")
    votes = (sketch.withColumn("_total", F.sum("n").over(group)).where(F.col("_total") >= LEAST_GROUP)
             .withColumn("n", F.ceil(F.col("n") * VOTE / F.col("_total")).cast("long")))
    found = fences(merge(votes, keys), keys).where(F.col("total") >= LEAST_SOURCES * VOTE)
    return found.select(*keys, "measure", F.col("fence").alias("ceiling"))


def thresholds(metrics: DataFrame) -> DataFrame:
    """One row per (lang, source) with a fence per measure, falling back to the
    language's and then to the whole corpus's merged sketch for small groups.

    No fence lies above the ceiling of its language's sources (of all sources
    where the language has few): where a quarter or more of a group is junk,
    its upper quartile is the junk's own value and would let all of it pass.
    """
    fine = sketches(metrics, ["lang", "source"])
    by_lang = fences(merge(fine, ["lang"]), ["lang"]).select(
        F.col("lang").alias("_l"), F.col("measure").alias("_m"), F.col("total").alias("lang_total"),
        F.col("fence").alias("lang_fence"))
    overall = fences(merge(fine, []), []).select(F.col("measure").alias("_a"), F.col("fence").alias("all_fence"))
    lang_top = ceilings(fine, ["lang"]).select(F.col("lang").alias("_tl"), F.col("measure").alias("_tm"),
                                               F.col("ceiling").alias("lang_top"))
    all_top = ceilings(fine, []).select(F.col("measure").alias("_ta"), F.col("ceiling").alias("all_top"))
    each = fences(fine, ["lang", "source"])
    joined = (each.join(by_lang, each["lang"].eqNullSafe(by_lang["_l"]) & (each["measure"] == by_lang["_m"]))
              .join(overall, F.col("measure") == F.col("_a"))
              .join(lang_top, each["lang"].eqNullSafe(lang_top["_tl"]) & (F.col("measure") == F.col("_tm")), "left")
              .join(all_top, F.col("measure") == F.col("_ta"), "left"))
    own = (F.when(F.col("total") >= LEAST_GROUP, F.col("fence"))
           .when(F.col("lang_total") >= LEAST_GROUP, F.col("lang_fence")).otherwise(F.col("all_fence")))
    chosen = F.least(own, F.coalesce("lang_top", "all_top"))      # a null ceiling bounds nothing
    return (joined.groupBy("lang", "source")
            .agg(*[F.max(F.when(F.col("measure") == m, chosen)).alias(f"max_{m}") for m in MEASURES]))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source", min_words: int = 50) -> DataFrame:
    """One row per row of ``docs``: its counts, measures, thresholds and verdict.

    ``base_failed``: fewer than ``min_words`` words, or more than half of the
    words in repeated 3-word windows.  ``kept``: not base_failed and no
    measure above its group's fence.  Null language or source form groups of
    their own; null and empty texts count zero words and fail the base rule;
    repeated rows are judged each; an empty table gives an empty result.
    """
    counts = text_metrics(docs, text_col, {"doc_id": id_col, "lang": lang_col, "source": source_col})
    metrics = store(counts.withColumns({m: share(n, d) for m, (n, d, _) in MEASURES.items()}), "quality-metrics")
    limit = thresholds(metrics).select(F.col("lang").alias("_lang"), F.col("source").alias("_source"),
                                       *[f"max_{m}" for m in MEASURES])
    # one row per group: the planner broadcasts it below the session's threshold
    # and otherwise joins by sort-merge, where AQE splits a hot group
    judged = metrics.join(limit, metrics["lang"].eqNullSafe(limit["_lang"])
                          & metrics["source"].eqNullSafe(limit["_source"]), "left").drop("_lang", "_source")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    within = F.lit(True)
    for m in MEASURES:
        within = within & (F.col(m) <= F.col(f"max_{m}"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & within)
