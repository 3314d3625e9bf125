"""Incremental ingest as batch operators: precedence merges, anti joins, calendar gaps, state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketclime.functions.calendar import is_trading_day
from marketclime.operators.climate import SETTLED
from marketclime.operators.quality import first_row_distinct

LOOKBACK_DAYS = 21
MAX_FETCH = 40
FINAL_STATUSES = ("ok", "empty_confirmed")


def latest_by(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The row with the largest ``order`` per key, combined map-side so that no key is ever gathered whole."""
    values = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def merge_weather(archive: DataFrame, recent: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Union by (site, date): settled archive days win over preliminary ones, later rows over earlier.

    Archive days without tmax are not settled yet and are left out.
    """
    settled = archive.filter(F.col("tmax").isNotNull()).withColumn("source", F.lit(SETTLED))
    fresh = recent.withColumn("source", F.lit("preliminary"))
    rows = settled.unionByName(fresh, allowMissingColumns=True)
    order = F.struct((F.col("source") == SETTLED).alias("settled"), F.col(ordinal).alias("o"))
    return latest_by(rows, ["site_id", "date"], order).drop(ordinal)


def last_row_per_day(weather: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """One row per (site, date); the last one read wins."""
    return latest_by(weather, ["site_id", "date"], F.col(ordinal)).drop(ordinal)


def new_rows(batch: DataFrame, stored: DataFrame, dedupe_batch: bool = False, ordinal: str = "ordinal") -> DataFrame:
    """Batch rows whose (date, item) is not stored yet.

    Repeats inside the batch are kept unless ``dedupe_batch`` is set.
    """
    fresh = batch.join(stored.select("date", "item"), ["date", "item"], "left_anti")
    return first_row_distinct(fresh, ordinal=ordinal) if dedupe_batch else fresh


def upsert_new_rows(stored: DataFrame, batch: DataFrame, **options) -> DataFrame:
    """Stored rows plus the new ones."""
    return stored.unionByName(new_rows(batch, stored, **options), allowMissingColumns=True)


def trading_days(bounds: DataFrame) -> DataFrame:
    """All trading days of a one-row frame with ``first`` and ``last``."""
    days = bounds.select(F.explode(F.sequence("first", "last")).alias("date"))
    return days.filter(is_trading_day(F.col("date")))


def missing_days(bounds: DataFrame, have: DataFrame, no_bulletin: DataFrame) -> DataFrame:
    """Trading days with neither rows nor a confirmed absence of a bulletin."""
    return (
        trading_days(bounds)
        .join(have.select("date").distinct(), "date", "left_anti")
        .join(no_bulletin.select("date").distinct(), "date", "left_anti")
    )


def wanted_days(
    today: Column,
    have: DataFrame,
    no_bulletin: DataFrame,
    lookback: int = LOOKBACK_DAYS,
    max_fetch: int = MAX_FETCH,
) -> DataFrame:
    """Days to fetch: the gaps of the look-back window before ``today``, newest first, at most ``max_fetch``.

    ``today`` is a literal or scalar date column.
    """
    bounds = have.sparkSession.range(1).select(
        F.date_sub(today, lookback).alias("first"), F.date_sub(today, 1).alias("last")
    )
    return missing_days(bounds, have, no_bulletin).orderBy(F.col("date").desc()).limit(max_fetch)


def unfetched_days(bounds: DataFrame, checkpoint: DataFrame, final: Sequence[str] = FINAL_STATUSES) -> DataFrame:
    """Trading days whose checkpoint status is absent or not final."""
    done = checkpoint.filter(F.col("status").isin(*final)).select(F.col("day").alias("date"))
    return trading_days(bounds).join(done, "date", "left_anti")


def observation_state(rows: DataFrame, no_bulletin: DataFrame) -> DataFrame:
    """One row: first and last day, distinct days, and the sorted dates without a bulletin.

    Both arrays hold calendar days, so their size is bounded by the calendar.
    """
    state = rows.agg(
        F.min("date").alias("first"), F.max("date").alias("last"), F.count_distinct("date").alias("days_with_data")
    )
    absent = no_bulletin.select("date").distinct().agg(F.sort_array(F.collect_list("date")).alias("no_bulletin"))
    return state.withColumn("no_bulletin", absent.scalar())


def update_state(state: DataFrame, rows: DataFrame, empties: DataFrame) -> DataFrame:
    """State after a run: spans of all rows now stored, earlier and new no-bulletin dates united."""
    known = state.select(F.explode("no_bulletin").alias("date"))
    return observation_state(rows, known.unionByName(empties.select("date")))
