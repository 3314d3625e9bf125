"""Price files: raw rows, cleaned rows and the monthly observation store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketclime.functions.calendar import month_key
from marketclime.functions.text import iso_date, plain_number, strip
from marketclime.operators.quality import with_order_ok
from marketclime.sources.reference import read_csv

# Column names of the published files.
OBSERVATION_FIELDS = ["date", "item", "unit", "price_low", "price_mode", "price_high", "quantity"]
RAW_FIELDS = [*OBSERVATION_FIELDS, "kind", "order_ok", "source_file"]
CLEAN_FIELDS = [
    "date",
    "item",
    "item_raw",
    "unit",
    "price_low",
    "price_mode",
    "price_high",
    "quantity",
    "order_ok",
    "outlier",
    "duplicate",
    "usable",
]
NUMBERS = ["price_low", "price_mode", "price_high", "quantity"]
FLAGS = ["order_ok", "outlier", "duplicate", "usable"]


def coerce_prices(rows: DataFrame) -> DataFrame:
    """Text columns to typed ones; what does not parse becomes null. Items are stripped."""
    typed = rows.withColumn("date", iso_date(F.col("date"))).withColumn("item", strip(F.col("item")))
    for column in NUMBERS:
        typed = typed.withColumn(column, plain_number(F.col(column)))
    for column in FLAGS:
        if column in rows.columns:
            typed = typed.withColumn(column, F.col(column).try_cast("int"))
    return typed


def read_raw_prices(spark: SparkSession, path: str) -> DataFrame:
    """Parsed price rows. The ordinal follows path order and row order within a file.

    A date the file writes badly is null; rows are kept, as every row is
    flagged rather than dropped later on.
    """
    return coerce_prices(read_csv(spark, path, RAW_FIELDS, "ordinal"))


def read_clean_prices(spark: SparkSession, path: str) -> DataFrame:
    """Cleaned rows that are usable and have a date and a modal price."""
    typed = coerce_prices(read_csv(spark, path, CLEAN_FIELDS, "ordinal").filter(F.col("usable") == "1"))
    return typed.filter(F.col("date").isNotNull() & F.col("price_mode").isNotNull())


def read_month_files(spark: SparkSession, path: str) -> DataFrame:
    """All monthly CSV files of a folder (gzip or plain), with ``order_ok`` derived.

    A gzip file is read by one task; the ordinal follows path order and row
    order within a file.
    """
    return with_order_ok(coerce_prices(read_csv(spark, path, OBSERVATION_FIELDS, "ordinal")))


def read_month_store(spark: SparkSession, path: str, months: list[str] | None = None) -> DataFrame:
    """The Parquet store, or only the named months of it (pruned by partition)."""
    store = spark.read.parquet(path)
    return store.filter(F.col("month").isin(*months)) if months else store


def well_formed(rows: DataFrame) -> DataFrame:
    """Rows whose date text has the length of an ISO date."""
    return rows.filter(F.length("date") == 10)


def with_month(rows: DataFrame) -> DataFrame:
    return rows.withColumn("month", month_key(F.col("date")))
