"""Sharding by vector bin packing: bytes, tokens and rows balanced together.

Equal texts form a group and stay in one shard.  Items are placed largest
first into the shard where the dot product of the item's vector (shares of all
bytes, tokens and rows) with the shard's residual capacity is highest.  Groups
above a set share of the corpus are items of their own (there can be only so
many), cut only where one shard's share cannot hold them; all smaller groups are bundled by hash, so the number of items depends
on the shard count and not on the corpus.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import number_rows, store

N_SHARDS = 40
#: bundles of small groups per shard; a group above 1 / (shards x BUNDLES) of
#: any dimension is an item of its own: at most 3 x shards x BUNDLES of them
BUNDLES = 64
#: a group above one shard's share is cut into pieces below this part of a shard, so
#: that what lies in several shards anyway can be balanced
PIECES = 4
#: bytes that a document costs besides its text
OVERHEAD = 16


def place_items(vectors: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of each item; ``vectors`` are shares (items x dimensions)."""
    room = np.full((n_shards, vectors.shape[1]), 1.0 / n_shards)
    out = np.zeros(len(vectors), dtype=np.int64)
    for i in np.argsort(-vectors.max(axis=1), kind="stable"):
        fit = room @ vectors[i]
        out[i] = int(np.argmax(fit))
        room[out[i]] -= vectors[i]
    return out


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes + 16), tokens (words), text_crc32 and the text's digest."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.col(text_col).isNull(), F.lit("null")).otherwise(F.md5(text.cast("binary"))).alias("digest"))


def assign(docs: DataFrame, n_shards: int = N_SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, tokens, text_crc32, digest, shard, slot of every row.

    ``slot`` counts 0, 1, ... inside a shard.  Null texts form one group;
    repeated rows are equal texts; an empty table gives an empty result.
    """
    rows = store(measured(docs, id_col, text_col), "shard-sizes")
    groups = rows.groupBy("digest").agg(*[F.sum(c).alias(c) for c in ("size", "tokens")], F.count(F.lit(1)).alias("rows"))
    dims = ["size", "tokens", "rows"]
    groups = store(groups, "shard-groups")
    total = groups.agg(*[F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in dims]).first()
    share = F.greatest(*[F.col(d) / F.lit(float(max(total[d], 1))) for d in dims])
    limit = 1.0 / (n_shards * BUNDLES)
    n_rows = int(total["rows"])
    # at most 3 / limit rows: one per group above the share
    # a group that one shard's share holds stays whole
    large = groups.where(share > limit).select("digest", *dims, F.when(share * n_shards <= 1, 1).otherwise(
        F.ceil(share * n_shards * PIECES)).cast("int").alias("pieces"))
    bundle = F.pmod(F.xxhash64("digest"), F.lit(n_shards * BUNDLES)).cast("string")
    # pieces of a cut group: its rows dealt by id
    keyed = (rows.join(F.broadcast(large.select("digest", "pieces")), "digest", "left")
             .withColumn("_item", F.when(F.col("pieces").isNull(), F.concat(F.lit("b"), bundle))
                         .otherwise(F.concat("digest", F.lit("-"), F.pmod(F.xxhash64("doc_id"), F.col("pieces")).cast("string"))))
             .drop("pieces"))
    items = (keyed.groupBy("_item").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"),
                                        F.count(F.lit(1)).alias("rows")).orderBy("_item").toPandas())
    vectors = items[dims].to_numpy(dtype=float) / np.maximum(items[dims].sum().to_numpy(dtype=float), 1.0)
    shards = place_items(vectors, n_shards)
    table = docs.sparkSession.createDataFrame(
        [(str(i), int(s)) for i, s in zip(items["_item"], shards, strict=True)], "_item string, shard int")
    placed = keyed.join(F.broadcast(table), "_item").drop("_item")
    ordered = placed.withColumn("_order", F.struct("doc_id", "digest"))
    return number_rows(ordered, "shard", "_order", "slot", n_rows).drop("_order")


def write_shards(docs: DataFrame, path: str, n_shards: int = N_SHARDS, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Write the rows of ``docs`` as one folder per shard, return the assignment.

    Rows find their shard by id and text.  Rows equal in both are dealt to the
    same shard (pieces of a cut group are dealt by id).
    """
    placed = store(assign(docs, n_shards, id_col, text_col), "shards")
    where = placed.groupBy("doc_id", "digest").agg(F.min("shard").alias("shard"))
    digest = F.when(F.col(text_col).isNull(), F.lit("null")).otherwise(F.md5(F.col(text_col).cast("binary")))
    rows = docs.withColumn("_id", F.col(id_col)).withColumn("_digest", digest)
    spot = where.select(F.col("doc_id").alias("_i"), F.col("digest").alias("_d"), F.col("shard").alias("_shard"))
    joined = rows.join(spot, rows["_id"].eqNullSafe(spot["_i"]) & (rows["_digest"] == spot["_d"]))
    joined.select(*docs.columns, "_shard").write.partitionBy("_shard").parquet(path)
    return placed
