"""CSV loading and typed tables: SRC-01, SRC-02, SRC-03, SRC-04, SRC-08.

All readers take an explicit schema (no inference pass over the data); typed
loads are written to parquet partitioned by year so later date windows prune
whole folders and the remaining filter reaches the row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.columns import nan_to_null
from ..params import BENCHMARK
from ..session import new_table_path

_CSV_READ = {"header": "true", "sep": ",", "quote": '"', "escape": '"', "mode": "FAILFAST"}
# writing must keep blanks: the staging table's leading/trailing blanks are data
_CSV_WRITE = {"header": "true", "sep": ",", "quote": '"', "escape": '"',
              "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_csv(df: DataFrame, path: str, header: bool = True) -> str:
    """Write a frame as CSV (header, comma, double quote), keeping blanks."""
    opts = dict(_CSV_WRITE, header=str(header).lower())
    df.write.mode("overwrite").options(**opts).csv(path)
    return path


def read_staging_csv(spark: SparkSession, path: str, schema=S.STAGING_COMPANY) -> DataFrame:
    """SRC-01: company list CSV into the all-string staging table."""
    return (spark.read.schema(schema).options(**_CSV_READ)
            .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
            .csv(path))


def read_company_file(spark: SparkSession, path: str, market: str) -> DataFrame:
    """SRC-01 per file: one market's company CSV (11 text columns), with the
    market attached as ``exchange`` -- the literal the reference types in for
    each import.  Union the three markets' frames for the staging table."""
    raw = (spark.read.schema(S.COMPANY_FILE).options(**_CSV_READ)
           .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path))
    return raw.select("symbol", F.lit(market).alias("exchange"), *[c for c in raw.columns if c != "symbol"])


#: column that holds a line which does not fit the declared columns
BAD_LINE = "_corrupt_record"


def read_company_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """SRC-01 for all markets' files of ``folder`` in one read: (staging rows, rejects).

    The market is the file's name without ``.csv``, in capitals (a file may be a folder of parts, as
    Spark writes it).  A line with more or fewer than the 11 declared columns, or with
    quotes that do not close, does not end the load: it is a reject (exchange, line).  The files are
    parsed once, into a table of the shared folder that both results read.
    """
    schema = T.StructType([*S.COMPANY_FILE.fields, T.StructField(BAD_LINE, T.StringType())])
    raw = (spark.read.schema(schema).options(**dict(_CSV_READ, mode="PERMISSIVE"))
           .option("columnNameOfCorruptRecord", BAD_LINE).option("recursiveFileLookup", "true")
           .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(folder))
    market = F.upper(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv(/[^/]*)?$", 1))
    parsed = new_table_path(spark, "company_lines")
    raw.withColumn("exchange", market).write.parquet(parsed)
    tagged = spark.read.parquet(parsed)
    good = tagged.where(F.col(BAD_LINE).isNull()).select(
        "symbol", "exchange", *[c for c in S.COMPANY_FILE.names if c != "symbol"])
    return good, tagged.where(F.col(BAD_LINE).isNotNull()).select("exchange", F.col(BAD_LINE).alias("line"))


def load_company_files(spark: SparkSession, folder: str, path: str, markets: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """SRC-01 + SRC-08 for three files: each market's staging rows are appended to the company table
    at ``path``, one insert a market as the reference does; (company table, rejects)."""
    staging, rejects = read_company_files(spark, folder)
    for market in markets:
        company_list_from_staging(staging.where(F.col("exchange") == market), market).write.mode("append").parquet(path)
    return spark.read.parquet(path), rejects


def company_list_from_staging(staging: DataFrame, market: str | None = None) -> DataFrame:
    """SRC-08 + CLN-03: ``INSERT INTO company_list SELECT symbol, '<market>', ...``.

    The reference runs the insert once per imported file with the market as a
    literal; here the market comes from the staging row's ``exchange`` (the
    file it came from), or from ``market`` for a single-file staging table.
    Text becomes numbers by ANSI cast: a malformed value fails the job.
    """
    mkt = F.lit(market) if market is not None else F.col("exchange")
    return staging.select(
        F.col("symbol"), mkt.alias("stock_mkt_name"), F.col("name").alias("company_name"),
        F.col("market_cap").cast("double").alias("market_cap"), F.col("country"),
        F.col("ipo_year").cast("int").alias("ipo_year"), F.col("sector"), F.col("industry"))


def read_quotes_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC-02: typed quotes CSV (ticker, date, 4 x real, numeric volume); NaN becomes NULL."""
    raw = spark.read.schema(S.EOD_QUOTES).options(**_CSV_READ).option("dateFormat", "yyyy-MM-dd").csv(path)
    return _without_nan(raw)


def _without_nan(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: nan_to_null(F.col(f.name)) for f in df.schema
                           if f.dataType.typeName() in ("float", "double")})


def store_by_year(df: DataFrame, path: str, date_col: str = "date") -> str:
    """Write a dated table in year folders.

    Rows are range-partitioned by date (many tasks, each a contiguous slice
    of dates -- never one task per year) and sorted by (date, key) inside a
    file, so each task writes into one or two year folders and row-group
    statistics on ``date`` prune within a year as well.
    """
    key = df.columns[0]
    (df.withColumn("year", F.year(date_col))
       .repartitionByRange(F.col(date_col), F.col(key)).sortWithinPartitions(date_col, key)
       .write.mode("overwrite").partitionBy("year").parquet(path))
    return path


def read_window(spark: SparkSession, path: str, start: str, end: str, columns: list[str],
                date_col: str = "date") -> DataFrame:
    """SRC-05: read a date window of a stored table, oldest first.

    The year partition filter prunes folders, the date filter is pushed to
    parquet, and only ``columns`` are read.
    """
    y0, y1 = int(start[:4]), int(end[:4])
    df = spark.read.parquet(path)
    return (df.where(F.col("year").between(y0, y1))
            .where(F.col(date_col).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
            .select(*columns))


# --- SRC-03: index file as downloaded ------------------------------------------

def index_download_frame(indices: DataFrame) -> DataFrame:
    """Shape an index table like the downloaded file: Date, Open, High, Low,
    Close, Adj Close, Volume -- numbers with thousands separators, volume '-'.

    Used to produce test input for :func:`read_index_csv`; the separators are
    inserted into the exact text of each float, so nothing is rounded.
    """
    def fmt(c):
        txt = F.col(c).cast("string")
        whole = F.regexp_replace(F.split(txt, r"\.").getItem(0), r"(\d)(?=(\d{3})+$)", "$1,")
        frac = F.regexp_extract(txt, r"(\..*)$", 1)
        return F.concat(whole, frac)
    return indices.select(
        F.date_format("date", "yyyy-MM-dd").alias("Date"), fmt("open").alias("Open"),
        fmt("high").alias("High"), fmt("low").alias("Low"), fmt("close").alias("Close"),
        fmt("adj_close").alias("Adj Close"), F.lit("-").alias("Volume"))


def read_index_csv(spark: SparkSession, path: str, symbol: str = BENCHMARK) -> DataFrame:
    """SRC-03: index CSV -> eod_indices_project.

    Strips formatting (thousands separators), adds the constant ``symbol``
    column and turns a non-numeric volume into 0.
    """
    raw = spark.read.schema(S.INDEX_DOWNLOAD).options(**_CSV_READ).csv(path)

    def num(c, t="float"):
        return F.regexp_replace(F.col(f"`{c}`"), ",", "").cast(t)

    vol = F.expr("try_cast(regexp_replace(Volume, ',', '') AS double)")
    typed = raw.select(
        F.lit(symbol).alias("symbol"), F.to_date("Date", "yyyy-MM-dd").alias("date"),
        num("Open").alias("open"), num("High").alias("high"), num("Low").alias("low"),
        num("Close").alias("close"), num("Adj Close").alias("adj_close"), vol.alias("volume"))
    return _without_nan(typed).withColumn("volume", F.coalesce("volume", F.lit(0.0)))


def read_calendar_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC-04: the calendar file (date, y, m, d, dow, trading)."""
    return spark.read.schema(S.CALENDAR).options(**_CSV_READ).option("dateFormat", "yyyy-MM-dd").csv(path)
