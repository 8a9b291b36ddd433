"""Tables stored by symbol: SRC-11 with the layout that repeated per-symbol access needs.

The reference puts an index on its stored prices; here the rows of a symbol lie in one
bucket, sorted by date.  Windows by symbol, per-symbol aggregates and the
previous-price self join then read the buckets side by side, without an exchange.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import new_table_path


def bucket_session(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` that shares its catalog and takes a table's buckets for a join on
    more columns than the bucket's (by default Spark asks for all of them)."""
    other = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.adaptive.enabled"):
        value = spark.conf.get(key, None)
        if value is not None:
            other.conf.set(key, value)
    other.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return other


def store_bucketed(df: DataFrame, name: str, key: str = "symbol", order: str = "date", buckets: int | None = None) -> DataFrame:
    """Write ``df`` bucketed by ``key`` and sorted by (``key``, ``order``), one file a bucket, and read it
    back in a :func:`bucket_session`.

    ``buckets`` (default: ``spark.sql.shuffle.partitions``) should give a bucket some hundred MB.  The files lie in
    the shared folder; the catalog entry, of a name used once, tells Spark of the layout.
    """
    spark = df.sparkSession
    n = int(buckets or spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    (df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key, order)
       .option("path", new_table_path(spark, name)).saveAsTable(table))
    return bucket_session(spark).table(table)
