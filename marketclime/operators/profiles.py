"""Item profiles for the manual crop mapping, and the counts of the parse report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketclime.functions.calendar import span_label
from marketclime.functions.text import month_label
from marketclime.operators.quantiles import exact_quantiles
from marketclime.session import cut_lineage

MIN_PER_MONTH = 5
MIN_MONTHS = 6
THIN_DAYS = 100


def item_profile(df: DataFrame, existing: DataFrame | None = None, min_days: int = 1) -> DataFrame:
    """Days seen, span, price level, peak and trough month per item.

    Rows that fail the price order count as seen but not in the statistics.
    Peak and trough need five prices in a month and six such months; ties go
    to the month listed first. A zero quantity counts as a value here.
    ``first_ordinal`` is the item's first row, dated or not.
    """
    dated = df.filter(F.col("date").isNotNull())
    seen = df.groupBy("item").agg(
        F.count("date").alias("days_seen"),
        F.min("ordinal").alias("first_ordinal"),
        F.min("date").alias("first_seen"),
        F.max("date").alias("last_seen"),
        F.count_if((F.col("order_ok") == 0) & F.col("date").isNotNull()).alias("flagged"),
    )
    seen = seen.filter(F.col("days_seen") > 0)
    good = dated.filter(F.coalesce(F.col("order_ok") != 0, F.lit(True)))
    # distinct values and their counts, written once: every median below comes from them
    priced = cut_lineage(
        good.filter(F.col("price_mode").isNotNull())
        .groupBy("item", F.month("date").alias("month"), "price_mode")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("ordinal").alias("ordinal")),
        "item-prices",
    )
    listed = cut_lineage(good.groupBy("item", "quantity").agg(F.count(F.lit(1)).alias("rows")), "item-quantities")
    price = exact_quantiles(priced, ["item"], "price_mode", {"median_mode_price": 0.5}, weight="rows", count_as="_np")
    quantity = exact_quantiles(listed, ["item"], "quantity", {"median_qty_t": 0.5}, weight="rows", count_as="_nq")

    monthly = exact_quantiles(priced, ["item", "month"], "price_mode", {"price": 0.5}, weight="rows")
    first_met = priced.groupBy("item", "month").agg(F.min("ordinal").alias("ordinal"))
    season = (
        monthly.filter(F.col("n") >= MIN_PER_MONTH)
        .join(first_met, ["item", "month"])
        .groupBy("item")
        .agg(
            F.count(F.lit(1)).alias("_months"),
            F.max_by("month", F.struct("price", -F.col("ordinal"))).alias("_peak"),
            F.min_by("month", F.struct("price", "ordinal")).alias("_trough"),
        )
        .filter(F.col("_months") >= MIN_MONTHS)
    )
    profile = (
        seen.filter(F.col("days_seen") >= min_days)
        .join(price, "item", "left")
        .join(quantity, "item", "left")
        .join(season, "item", "left")
    )
    if existing is not None:
        profile = profile.join(existing.select("item", "crop_id", "notes"), "item", "left")
    else:
        profile = profile.withColumn("crop_id", F.lit("")).withColumn("notes", F.lit(""))
    return profile.select(
        "item",
        F.coalesce("crop_id", F.lit("")).alias("crop_id"),
        "days_seen",
        "first_seen",
        "last_seen",
        "median_mode_price",
        month_label(F.col("_peak")).alias("peak_month"),
        month_label(F.col("_trough")).alias("trough_month"),
        "median_qty_t",
        F.coalesce("notes", F.lit("")).alias("notes"),
        "flagged",
        span_label(F.col("first_seen"), F.col("last_seen")).alias("span"),
        "first_ordinal",
    )


def top_items(profile: DataFrame, n: int = 30) -> DataFrame:
    """The items worth mapping first; of items seen equally often, the one listed first."""
    return profile.orderBy(F.col("days_seen").desc(), "first_ordinal").limit(n)


def mapping_coverage(df: DataFrame, existing: DataFrame, min_days: int = 1) -> DataFrame:
    """One row: rows read, dated rows, distinct items, items above the threshold, mapped items, thin items."""
    seen = df.groupBy("item").agg(F.count("date").alias("days_seen"), F.count(F.lit(1)).alias("_rows"))
    seen = seen.join(existing.select("item", "crop_id"), "item", "left")
    kept = F.col("days_seen") >= min_days
    return seen.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows_read"),
        F.sum("days_seen").alias("dated_rows"),
        F.count(F.lit(1)).alias("distinct_items"),
        F.count_if(kept).alias("items"),
        F.count_if(kept & (F.coalesce("crop_id", F.lit("")) != "")).alias("mapped"),
        F.count_if(kept & (F.col("days_seen") < THIN_DAYS)).alias("thin_items"),
    )


def parse_summary(rows: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """One row: rows, span, distinct days and items, order failures, missing prices; page counts if given.

    ``pages`` has one row per page and its ``row_count``.
    """
    summary = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("date").alias("first"),
        F.max("date").alias("last"),
        F.count_distinct("date").alias("days"),
        F.count_if(F.col("order_ok") == 0).alias("order_failures"),
        F.count_if(F.col("order_ok").isNull()).alias("missing_price"),
    )
    items = rows.select("item").distinct().agg(F.count(F.lit(1)).alias("items"))
    summary = summary.withColumn("items", items.scalar())
    if pages is None:
        return summary
    read = pages.agg(F.count(F.lit(1)).alias("pages"))
    empty = pages.agg(F.count_if(F.col("row_count") == 0).alias("empty_pages"))
    return summary.withColumn("pages", read.scalar()).withColumn("empty_pages", empty.scalar())


def unit_counts(rows: DataFrame) -> DataFrame:
    """Rows per packaging unit; prices of different units are not comparable."""
    return rows.groupBy("unit").agg(F.count(F.lit(1)).alias("rows"))


def order_failures_by_year(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.year("date").alias("year")).agg(
        F.count_if(F.col("order_ok") == 0).alias("failures"), F.count(F.lit(1)).alias("total")
    )


def failing_rows(rows: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` rows whose prices are out of order, in (date, item) order."""
    failing = rows.filter(F.col("order_ok") == 0).orderBy("date", "item", "ordinal").limit(n)
    return failing.select("date", "item", "price_low", "price_mode", "price_high")


def days_per_year(rows: DataFrame) -> DataFrame:
    """Distinct market days per year."""
    days = rows.select("date").distinct()
    return days.groupBy(F.year("date").alias("year")).agg(F.count("date").alias("days"))


def frequent_items(rows: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` items with most rows; of equal counts, the item listed first."""
    counts = rows.groupBy("item").agg(F.count(F.lit(1)).alias("rows"), F.min("ordinal").alias("_first"))
    return counts.orderBy(F.col("rows").desc(), "_first").limit(n).drop("_first")
