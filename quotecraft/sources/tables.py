"""Table lifecycle on files: SRC-06, SRC-07, SRC-10, SRC-11, SRC-12, SRC-13, SRC-15.

Parquet tables do not accept UPDATE, DELETE or constraint DDL; the study's
table operations map to writing new versions:

- CREATE TABLE with declared columns -> :func:`schemas.conform` + write
- INSERT VALUES / INSERT SELECT       -> :func:`append_rows` / ``mode("append")``
- TRUNCATE / DELETE FROM              -> :func:`overwrite` (``mode("overwrite")``)
- SELECT ... INTO                      -> :func:`store_query`
- ALTER TABLE ADD COLUMN               -> :func:`add_columns`
- CREATE OR REPLACE VIEW               -> :func:`create_view`
- DROP TABLE / VIEW                    -> :func:`drop`
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import new_table_path


def add_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """SRC-12: ``ALTER TABLE ADD COLUMN c type`` -- new columns start NULL."""
    for c, t in columns.items():
        df = df.withColumn(c, F.lit(None).cast(t))
    return df


def append_rows(df: DataFrame, rows: list[tuple], spark: SparkSession | None = None) -> DataFrame:
    """SRC-07: ``INSERT INTO t VALUES (...)`` -- literal rows in ``df``'s schema."""
    spark = spark or df.sparkSession
    lit_df = spark.createDataFrame(rows, schema=T.StructType(
        [T.StructField(f.name, f.dataType, True) for f in df.schema.fields]))
    return df.unionByName(lit_df)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists",
                partition_by: list[str] | None = None) -> str:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def append(df: DataFrame, path: str) -> str:
    """SRC-08/09: ``INSERT INTO t SELECT ...`` on a file table."""
    return write_table(df, path, "append")


def overwrite(df: DataFrame, path: str) -> str:
    """SRC-10: ``TRUNCATE`` + reload, as one overwrite of the table's files."""
    return write_table(df, path, "overwrite")


def store_query(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """SRC-11: ``SELECT ... INTO name`` -- write once, read back the stored table.

    The read-back cuts the lineage: later jobs start from the files in the
    shared folder, not from a recomputation.
    """
    path = write_table(df, new_table_path(spark, name))
    return spark.read.parquet(path)


def create_view(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """SRC-13: ``CREATE OR REPLACE VIEW`` -- a session temp view, read by name."""
    df.createOrReplaceTempView(name)
    return spark.table(name)


def drop(spark: SparkSession, name: str | None = None, path: str | None = None) -> None:
    """SRC-15: drop a view by name and/or a file table by path (IF EXISTS)."""
    if name is not None:
        spark.catalog.dropTempView(name)
    if path is not None:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(jvm_path):
            fs.delete(jvm_path, True)


def exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)
