"""Weekly, seasonal and latest-day aggregates of cleaned prices.

Usable rows are unique per (date, listed item), so every group below is
bounded by the calendar and the built-in exact percentile is safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketclime.functions.calendar import week_key, week_of_year, week_start
from marketclime.functions.numbers import percent_change
from marketclime.operators.numbering import number_rows
from marketclime.session import cut_lineage

MIN_DAYS = 150
MIN_OBSERVATIONS = 4


def usable_rows(clean: DataFrame) -> DataFrame:
    """Rows that passed every check, with low and high nulled together and a zero quantity nulled."""
    pair = F.col("price_low").isNotNull() & F.col("price_high").isNotNull()
    usable = (F.col("usable") == 1) & F.col("date").isNotNull() & F.col("price_mode").isNotNull()
    return clean.filter(usable).select(
        "date",
        "item",
        "price_mode",
        F.when(pair, F.col("price_low")).alias("price_low"),
        F.when(pair, F.col("price_high")).alias("price_high"),
        F.col("quantity").alias("quantity_listed"),
        F.when(F.col("quantity") != 0, F.col("quantity")).alias("quantity"),
        "ordinal",
    )


def weekly_prices(clean: DataFrame) -> DataFrame:
    """Median mode, low, high and quantity per item and Saturday-start week."""
    weekly = (
        usable_rows(clean)
        .withColumn("week", week_key(F.col("date")))
        .groupBy("item", "week")
        .agg(
            F.median("price_mode").alias("mode"),
            F.median("price_low").alias("low"),
            F.median("price_high").alias("high"),
            F.median("quantity").alias("qty_t"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    return weekly.withColumn("week_start", week_start(F.col("week")))


def seasonal_profile(clean: DataFrame, min_observations: int = MIN_OBSERVATIONS) -> DataFrame:
    """Price percentiles and median quantity per item and week of year, across all years."""
    levels = F.percentile("price_mode", F.array(*[F.lit(q) for q in (0.10, 0.25, 0.50, 0.75, 0.90)]))
    seasonal = (
        usable_rows(clean)
        .withColumn("week_of_year", week_of_year(F.col("date")))
        .groupBy("item", "week_of_year")
        .agg(levels.alias("_p"), F.median("quantity").alias("qty_t"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_observations)
    )
    names = ["p10", "p25", "median", "p75", "p90"]
    return seasonal.select(
        "item", "week_of_year", *[F.col("_p")[i].alias(c) for i, c in enumerate(names)], "qty_t", "n"
    )


def series_index(clean: DataFrame, mapping: DataFrame, min_days: int = MIN_DAYS) -> DataFrame:
    """One row per series long enough to chart.

    Series are numbered by row count before the length filter, so ids have
    gaps; a series keeps its id when the threshold changes.
    """
    series = (
        usable_rows(clean)
        .groupBy("item")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_distinct("date").alias("days"),
            F.min("date").alias("first"),
            F.max("date").alias("last"),
            F.median("price_mode").alias("median_price"),
            F.median("quantity").alias("median_qty_t"),
            F.min("ordinal").alias("_first_ordinal"),
        )
    )
    numbered = number_rows(series, "rows", "_first_ordinal", "_number")
    return (
        numbered.filter(F.col("days") >= min_days)
        .join(mapping.select("item", "crop_id"), "item", "left")
        .select(
            F.format_string("s%03d", F.col("_number")).alias("series_id"),
            "item",
            F.col("crop_id").alias("crop"),
            "days",
            "first",
            "last",
            "median_price",
            "median_qty_t",
            F.col("crop_id").isNotNull().alias("mapped"),
        )
    )


def market_days(clean: DataFrame) -> DataFrame:
    """One row: the latest market day and the one before it, over all items."""
    dates = clean.filter((F.col("usable") == 1) & F.col("date").isNotNull() & F.col("price_mode").isNotNull())
    return _last_days(dates.select("date").distinct())


def _last_days(dates: DataFrame) -> DataFrame:
    """One row: the last and the last but one of distinct dates, null where there is none."""
    last = dates.orderBy(F.col("date").desc()).limit(2)
    return last.agg(
        F.max("date").alias("latest"), F.when(F.count(F.lit(1)) > 1, F.min("date")).alias("previous")
    )


def latest_snapshot(clean: DataFrame, mapping: DataFrame, min_observations: int = MIN_OBSERVATIONS) -> DataFrame:
    """Every item listed on the latest market day, against the previous market day and its own week of year.

    One conditional aggregation per item over the rows of the two days and of
    the latest day's week of year. The usable rows are written out first, so
    cleaning runs once and not again for the two days.
    """
    rows = cut_lineage(usable_rows(clean), "usable")
    days = cut_lineage(_last_days(rows.select("date").distinct()), "market-days")
    latest = days.select("latest").scalar()
    previous = days.select("previous").scalar()
    week = days.select(week_of_year(F.col("latest"))).scalar()

    marked = rows.select(
        "item",
        "price_mode",
        "price_low",
        "price_high",
        "quantity_listed",
        "ordinal",
        (F.col("date") == latest).alias("_today"),
        F.coalesce(F.col("date") == previous, F.lit(False)).alias("_before"),
        (week_of_year(F.col("date")) == week).alias("_same_week"),
    )
    in_history = F.col("_same_week") & ~F.col("_today")
    today = F.when(F.col("_today"), F.col("ordinal"))
    before = F.when(F.col("_before"), F.col("ordinal"))
    items = (
        marked.filter(F.col("_today") | F.col("_before") | F.col("_same_week"))
        .groupBy("item")
        .agg(
            F.min_by(F.struct("price_low", "price_mode", "price_high", "quantity_listed"), today).alias("_now"),
            F.min_by("price_mode", before).alias("prev_mode"),
            F.median(F.when(in_history, F.col("price_mode"))).alias("_week_median"),
            F.count_if(in_history).alias("week_n"),
        )
        .filter(F.col("_now").isNotNull())
    )
    return items.join(mapping.select("item", "crop_id"), "item", "left").select(
        "item",
        F.col("crop_id").alias("crop"),
        F.col("_now.price_low").alias("low"),
        F.col("_now.price_mode").alias("mode"),
        F.col("_now.price_high").alias("high"),
        F.col("_now.quantity_listed").alias("qty_t"),
        "prev_mode",
        percent_change(F.col("_now.price_mode"), F.col("prev_mode")).alias("change_pct"),
        F.when(F.col("week_n") >= min_observations, F.col("_week_median")).alias("week_median"),
        "week_n",
    )


def by_quantity(snapshot: DataFrame) -> DataFrame:
    """Snapshot order: largest quantity first, unknown quantity as zero."""
    return snapshot.orderBy(F.coalesce(F.round("qty_t", 2), F.lit(0.0)).desc(), "item")
