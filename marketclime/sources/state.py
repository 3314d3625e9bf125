"""Fetch checkpoints and observation state kept as small JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "struct<status: string, at: string, rows: int, note: string>"
STATE = "struct<first: date, last: date, days_with_data: int, no_bulletin: array<date>>"


def repaired_status(status: Column) -> Column:
    """An early form recorded a bare "empty" as final; it is demoted so the day is tried again."""
    return F.when(status == "empty", "empty_unverified").otherwise(status)


def checkpoint_rows(documents: DataFrame, column: str = "value") -> DataFrame:
    """JSON objects of day to entry, one row per day, statuses repaired."""
    entries = F.from_json(F.col(column), f"map<string, {ENTRY}>")
    rows = documents.select(F.explode(entries).alias("_day", "_entry"))
    return rows.select(
        F.try_to_date("_day", "yyyy-MM-dd").alias("day"),
        repaired_status(F.col("_entry.status")).alias("status"),
        F.col("_entry.at").alias("at"),
        F.col("_entry.rows").alias("rows"),
        F.col("_entry.note").alias("note"),
    )


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """Checkpoint files; each is one small document."""
    return checkpoint_rows(spark.read.text(path, wholetext=True))


def status_counts(checkpoint: DataFrame) -> DataFrame:
    return checkpoint.groupBy("status").agg(F.count(F.lit(1)).alias("days"))


def confirmed_empty(checkpoint: DataFrame) -> DataFrame:
    """Days known to have no bulletin."""
    return checkpoint.filter(F.col("status") == "empty_confirmed").select(F.col("day").alias("date"))


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The observation state document as one row."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.from_json("value", STATE).alias("s")).select("s.*")
