"""Writers: month partitions, flagged rows, review tables and nested JSON outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketclime.sources.prices import OBSERVATION_FIELDS, with_month


def _sorted_months(rows: DataFrame, *order: str) -> DataFrame:
    """Rows sorted by month, date and item across files.

    Ranges, not hashes of the month: a month that holds a third of all rows is
    cut into several files, a small one stays in one.
    """
    months = with_month(rows)
    return months.repartitionByRange("month", *order).sortWithinPartitions("month", *order)


def write_month_store(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet partitioned by month. Mode "overwrite" replaces only the months at hand."""
    order = [c for c in ("date", "item", "ordinal") if c in rows.columns]
    writer = _sorted_months(rows, *order).write.partitionBy("month").mode(mode)
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def write_month_files(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Gzip CSV per month with a header, values as text, nulls blank."""
    order = [c for c in ("date", "item", "ordinal") if c in rows.columns]
    text = _sorted_months(rows, *order).select(*OBSERVATION_FIELDS, "month")
    writer = text.write.partitionBy("month").mode(mode).option("partitionOverwriteMode", "dynamic")
    writer.option("header", True).option("compression", "gzip").option("nullValue", "").csv(path)


def rewrite_months(rows: DataFrame, path: str) -> None:
    """Replace the months present in ``rows``; all other months stay as they are."""
    write_month_store(rows, path, mode="overwrite")


def write_flagged(clean: DataFrame, path: str) -> None:
    """All rows with their flags."""
    clean.write.mode("overwrite").parquet(path)


def write_review(pairs: DataFrame, path: str) -> None:
    """Name pairs, likeliest renames first."""
    ordered = pairs.orderBy("cooccurrence_rate", "item_a", "item_b")
    ordered.write.mode("overwrite").option("header", True).csv(path)


def series_payload(index: DataFrame, weekly: DataFrame, seasonal: DataFrame) -> DataFrame:
    """One nested row per series: index entry, weekly and seasonal tables as arrays.

    A series has one weekly row per calendar week and at most 53 seasonal
    rows, so the arrays are bounded by the calendar.
    """
    ids = index.select("series_id", "item")
    weeks = (
        weekly.join(ids, "item")
        .groupBy("series_id")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "week",
                        F.round("mode", 1).alias("mode"),
                        F.round("low", 1).alias("low"),
                        F.round("high", 1).alias("high"),
                        F.round("qty_t", 2).alias("qty_t"),
                        "n",
                        "week_start",
                    )
                )
            ).alias("weekly")
        )
    )
    levels = [F.round(c, 1).alias(c) for c in ("p10", "p25", "median", "p75", "p90")]
    seasons = (
        seasonal.join(ids, "item")
        .groupBy("series_id")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("week_of_year", *levels, F.round("qty_t", 2).alias("qty_t"), "n"))
            ).alias("seasonal")
        )
    )
    entry = index.withColumnRenamed("item", "name").withColumn("members", F.array("name"))
    return entry.join(weeks, "series_id", "left").join(seasons, "series_id", "left")


def write_series(payload: DataFrame, path: str) -> None:
    """JSON per series id, so that a reader opens only the series it shows."""
    payload.write.mode("overwrite").partitionBy("series_id").json(path)


def index_payload(index: DataFrame) -> DataFrame:
    """Series index entries with display rounding."""
    return index.select(
        F.col("series_id").alias("id"),
        F.col("item").alias("name"),
        "crop",
        "days",
        "first",
        "last",
        F.round("median_price", 1).alias("median_price"),
        F.round("median_qty_t", 2).alias("median_qty_t"),
        "mapped",
    )


def snapshot_payload(snapshot: DataFrame) -> DataFrame:
    """Latest-day entries with display rounding, largest quantity first."""
    rounded = snapshot.select(
        "item",
        "crop",
        *[F.round(c, 1).alias(c) for c in ("low", "mode", "high")],
        F.round("qty_t", 2).alias("qty_t"),
        *[F.round(c, 1).alias(c) for c in ("prev_mode", "change_pct", "week_median")],
        "week_n",
    )
    return rounded.orderBy(F.coalesce("qty_t", F.lit(0.0)).desc(), "item")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def climate_document(frost: DataFrame, monthly: DataFrame, heat: DataFrame, seasons: DataFrame) -> DataFrame:
    """One nested row per site: frost by threshold, twelve months with heat days, rain by season.

    Every array holds at most one entry per threshold, month or year.
    """

    def entries(df: DataFrame, alias: str) -> DataFrame:
        columns = [c for c in df.columns if c != "site_id"]
        return df.groupBy("site_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(alias))

    hot = heat.groupBy("site_id", "month").agg(
        F.sort_array(F.collect_list(F.struct("threshold", "days_per_year"))).alias("heat_days_per_year")
    )
    months = monthly.join(hot, ["site_id", "month"], "left")
    return (
        entries(frost, "frost")
        .join(entries(months, "monthly"), "site_id", "left")
        .join(entries(seasons.select("site_id", "season", "rain_mm"), "seasonal_rainfall_mm"), "site_id", "left")
    )
