"""Small helpers the text operators share: stored tables, word hashes, numbering."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import new_table_path

#: bytes of text that one block of documents aims at; a block is one Python group, whose
#: arrays take some thirty times as much memory
BLOCK_BYTES = 3 << 20

_A = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later steps
    neither recompute it nor lose it with an executor."""
    spark, path = df.sparkSession, new_table_path(df.sparkSession, name)
    # a stored step does not need its shuffle files any longer
    drop = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(drop, "false")
    spark.conf.set(drop, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(drop, before)
    return spark.read.schema(df.schema).parquet(path)


def to_text(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns as strings while rows pass through pandas, which would turn
    whole numbers beside nulls into floats."""
    return df.withColumns({n: F.col(n).cast("string") for n in names})


def from_text(df: DataFrame, like: DataFrame, names: list[str]) -> DataFrame:
    """Undo :func:`to_text`: the types that ``names`` have in ``like``."""
    return df.withColumns({n: F.col(n).cast(like.schema[n].dataType) for n in names})


def words_of(raw: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text: runs of bytes other than 0x20 and 0x09-0x0D.
    ``bytes.split`` without arguments splits at exactly these six."""
    return raw.split() if raw else []


def mix64(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix)."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """(n, 2) unsigned 64-bit halves of each word's 128-bit hash."""
    import xxhash

    raw = b"".join(map(xxhash.xxh3_128_digest, words))
    return np.frombuffer(raw, dtype=np.uint64).reshape(-1, 2)


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive entries of ``h`` (1-d, uint64).

    Runs of 1, 2, 4, ... entries are combined pairwise, so the cost is about
    2 log2(width) vector steps instead of ``width``.
    """
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out, at, run, size, left = None, 0, h, 1, width
    while left:
        if left & 1:
            part = run[at:at + n]
            out = part.copy() if out is None else mix64(out * _A + part)
            at += size
        left >>= 1
        if left:
            run = mix64(run[:-size] * _A + run[size:] + np.uint64(size))
            size *= 2
    return out


def block_key(n_blocks: int, *cols: str) -> Column:
    """Block of a row by the hash of its values, the same in every run."""
    return F.pmod(F.xxhash64(*cols), F.lit(n_blocks)).cast("int")


def block_count(docs: DataFrame, text_col: str, block_bytes: int = BLOCK_BYTES) -> tuple[int, int]:
    """(number of blocks for ``docs``, bytes of its texts), from all rows."""
    row = docs.agg(F.sum(F.octet_length(F.col(text_col))).alias("b"), F.count(F.lit(1)).alias("n")).first()
    total = int(row["b"] or 0)
    return max(1, math.ceil(total / block_bytes), math.ceil(row["n"] / 200_000)), total


def stored_order(df: DataFrame, out: str) -> DataFrame:
    """``df``, as read back from :func:`store`, with ``out``: 0, 1, 2, ... in
    the order in which its rows were written."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    # part-<task>-<id>-c<file of the task>: digits beyond five make names that do not sort as text
    keyed = df.withColumns({"_task": F.regexp_extract(name, r"^part-(\d+)", 1).cast("long"),
                            "_file": F.regexp_extract(name, r"-c(\d+)\.", 1).try_cast("long"),
                            "_at": F.col("_metadata.row_index")})
    # one row per file
    sizes = keyed.groupBy("_task", "_file").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_task", "_file").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(F.col("_task").alias("_t"), F.col("_file").alias("_f"),
                         F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    return (keyed.join(F.broadcast(shift), (F.col("_task") == F.col("_t")) & F.col("_file").eqNullSafe(F.col("_f")))
            .withColumn(out, F.col("_shift") + F.col("_at")).select(*df.columns, out))


def number_rows(df: DataFrame, key: str, order: str, out: str, rows: int,
                per_bucket: int = 50_000) -> DataFrame:
    """``df`` with ``out``: 0, 1, 2, ... without gaps inside each ``key``.

    A key may hold any share of the rows, so no window covers a whole key:
    rows are numbered inside (key, bucket of the ``order`` value's hash) and
    shifted by the sizes of the buckets before.  ``rows`` is the row count.
    """
    n = max(1, math.ceil(rows / per_bucket))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(order), F.lit(n)).cast("int"))
    if n == 1:
        w = Window.partitionBy(key).orderBy(order)
        return df.withColumn(out, (F.row_number().over(w) - 1).cast("long")).drop("_bucket")
    sizes = df.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    w = Window.partitionBy(key, "_bucket").orderBy(order)
    return (df.withColumn("_row", F.row_number().over(w) - 1)
            .join(shift, [key, "_bucket"])
            .withColumn(out, (F.col("_shift") + F.col("_row")).cast("long"))
            .drop("_bucket", "_row", "_shift"))
