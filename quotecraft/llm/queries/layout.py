"""Queries of the mixing, sharding and packing operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import mixing, packing, sharding
from ..common import load
from . import query


@query("op3_source_mixing")
def op3(spark, sf_dir):
    return mixing.schedule(load(spark, sf_dir, "documents"))


@query("op4_vector_sharding")
def op4(spark, sf_dir):
    placed = sharding.assign(load(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@query("op6_best_fit_packing")
def op6(spark, sf_dir):
    placed = packing.pack(load(spark, sf_dir, "documents"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
