"""Queries of the neighbour search, substring dedup and n-gram join."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import neighbours, ngram_join, substring_dedup
from ..common import load
from . import query


@query("op1_nn_descent")
def op1(spark, sf_dir):
    table = load(spark, sf_dir, "embeddings")
    return neighbours.nearest(table, table.where("vec_id % 20 = 0"), k=20)


@query("op2_substring_dedup")
def op2(spark, sf_dir):
    cut = substring_dedup.remove_repeats(load(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query("op8_ngram_jaccard_join")
def op8(spark, sf_dir):
    found = ngram_join.ngram_components(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")
