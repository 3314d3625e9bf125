"""Nested documents of the price and weather results: one row per document, as a table and as JSON text.

Every array is bounded by the calendar, by the twelve months or by the items of
one market day. Numbers are rounded for display to ``digits`` places (quantities
to one more); with ``digits`` None they stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketclime.operators import climate, prices
from marketclime.session import cut_lineage


def _shown(column: str, digits: int | None, more: int = 0) -> Column:
    return F.col(column) if digits is None else F.round(column, digits + more).alias(column)


def _entries(rows: DataFrame, by: str, alias: str, *columns: Column | str) -> DataFrame:
    """The rows of each ``by`` as a sorted array of structs; the first column orders them."""
    return rows.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(alias))


def series_table(clean: DataFrame, mapping: DataFrame, min_days: int = prices.MIN_DAYS, digits: int | None = 1) -> DataFrame:
    """One row per series: index entry, its weeks and its weeks of the year."""
    index = prices.series_index(clean, mapping, min_days)
    ids = index.select("series_id", "item")
    weeks = prices.weekly_prices(clean).join(ids, "item")
    shown = [_shown(c, digits) for c in ("mode", "low", "high")]
    weekly = _entries(weeks, "series_id", "weekly", "week", *shown, _shown("qty_t", digits, 1), "n", "week_start")
    seasons = prices.seasonal_profile(clean).join(ids, "item")
    levels = [_shown(c, digits) for c in ("p10", "p25", "median", "p75", "p90")]
    seasonal = _entries(seasons, "series_id", "seasonal", "week_of_year", *levels, _shown("qty_t", digits, 1), "n")
    entry = index.select(
        "series_id", F.col("item").alias("name"), "crop", F.array("item").alias("members"), "first", "last", "days",
        _shown("median_price", digits), _shown("median_qty_t", digits, 1), "mapped",
    )
    return entry.join(weekly, "series_id", "left").join(seasonal, "series_id", "left")


def latest_table(clean: DataFrame, mapping: DataFrame, digits: int | None = 1) -> DataFrame:
    """One row: the latest market day, the one before, and every item of the latest, largest quantity first.

    Unknown quantities count as zero; equal ones go by the item's first listing
    of all. Without any usable row there is no document.
    """
    rows = cut_lineage(clean.filter("usable = 1"), "usable-rows")
    listed = prices.usable_rows(rows).groupBy("item").agg(F.min("ordinal").alias("_first"))
    snapshot = prices.latest_snapshot(rows, mapping).join(listed, "item")
    shown = snapshot.select(
        (-F.coalesce(F.round("qty_t", 2) if digits is not None else F.col("qty_t"), F.lit(0.0))).alias("_less"),
        "_first",
        F.struct(
            "item", "crop", *[_shown(c, digits) for c in ("low", "mode", "high")], _shown("qty_t", digits, 1),
            _shown("prev_mode", digits), _shown("change_pct", digits), _shown("week_median", digits), "week_n",
        ).alias("entry"),
    )
    items = shown.agg(F.sort_array(F.collect_list(F.struct("_less", "_first", "entry"))).alias("_items"))
    days = prices.market_days(rows).filter(F.col("latest").isNotNull())
    # one row on either side
    both = days.withColumn("_one", F.lit(1)).join(items.withColumn("_one", F.lit(1)), "_one")
    return both.select(F.col("latest").alias("date"), "previous", F.transform("_items", lambda x: x["entry"]).alias("items"))


def weather_table(weather: DataFrame, digits: int | None = 1, min_days: int = climate.MIN_YEAR_DAYS) -> DataFrame:
    """One row per site: span, complete years, days, months and October to September rain, missing rain and ET0 as zero."""
    known = weather.withColumn("precip", F.coalesce("precip", F.lit(0.0))).withColumn("et0", F.coalesce("et0", F.lit(0.0)))
    span = weather.groupBy("site_id").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    numbers = [_shown(c, digits) for c in ("tmax", "tmin", "rain_mm", "et0_mm")]
    daily = _entries(climate.daily_payload(weather), "site_id", "daily", "epoch_day", *numbers, "settled")
    means = [_shown(c, digits) for c in ("tmax", "tmin", "rain", "et0")]
    monthly = climate.monthly_climatology(known, min_days=min_days)
    monthly = _entries(monthly, "site_id", "monthly", "month", *means, _shown("frost_nights", digits, 1))
    settled = known.filter(F.col("tmax").isNotNull())
    seasons = climate.hydro_rain(settled, min_days=min_days)
    seasons = _entries(seasons, "site_id", "seasonal_rain", "season", _shown("rain_mm", digits))
    out = span.join(_years(weather, ["tmax"], min_days), "site_id", "left")
    for part in (daily, monthly, seasons):
        out = out.join(part, "site_id", "left")
    return out


def _years(weather: DataFrame, require: list[str], min_days: int) -> DataFrame:
    years = climate.complete_years(weather, require, min_days=min_days) if require else climate.complete_years(weather, min_days=min_days)
    return years.groupBy("site_id").agg(F.sort_array(F.collect_list("year")).alias("complete_years"))


def climate_table(
    weather: DataFrame, thresholds: tuple[float, ...] = climate.FROST_THRESHOLDS, gdd_from: tuple[int, int] | None = None,
    gdd_base: float = 10.0, min_days: int = climate.MIN_YEAR_DAYS,
) -> DataFrame:
    """One row per site: complete years, frost by threshold, months with hot days, seasonal rain and, from a start day, heat sums."""
    years = _years(weather, [], min_days)
    frost = climate.frost_summary(weather, thresholds, min_days=min_days)
    frost = _entries(frost, "site_id", "frost", "threshold", *[c for c in frost.columns if c not in ("site_id", "threshold")])
    heat = _heat(weather, min_days)
    monthly = climate.monthly_climatology_totals(weather, min_days).join(heat, ["site_id", "month"], "left")
    monthly = _entries(monthly, "site_id", "monthly", "month", *[c for c in monthly.columns if c not in ("site_id", "month")])
    seasons = _entries(climate.hydro_rain(weather, min_days=min_days), "site_id", "seasonal_rainfall_mm", "season", "rain_mm")
    out = years
    for part in (frost, monthly, seasons):
        out = out.join(part, "site_id", "left")
    if gdd_from:
        hits = climate.gdd_days_to_target(weather, *gdd_from, gdd_base, min_days=min_days)
        targets = _entries(hits, "site_id", "days_to_target", "target", "median_days", "fastest", "slowest", "years")
        start = F.lit(f"{gdd_from[0]:02d}-{gdd_from[1]:02d}")
        gdd = F.struct(start.alias("start"), F.lit(gdd_base).alias("base_c"), F.col("days_to_target"))
        out = out.join(targets, "site_id", "left").withColumn("gdd", gdd).drop("days_to_target")
    return out


def _heat(weather: DataFrame, min_days: int) -> DataFrame:
    hot = climate.heat_days(weather, min_days=min_days)
    return hot.groupBy("site_id", "month").agg(F.sort_array(F.collect_list(F.struct("threshold", "days_per_year"))).alias("heat_days"))


def documents(table: DataFrame, key: Column | str) -> DataFrame:
    """key and document of every row of ``table``; nulls are written out."""
    name = F.col(key) if isinstance(key, str) else key
    return table.select(name.cast("string").alias("key"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("document"))


def parsed(found: DataFrame, table: DataFrame) -> DataFrame:
    """Documents read back, with the columns of the ``table`` they were made of."""
    return found.select(F.from_json("document", table.schema).alias("_d")).select("_d.*")
