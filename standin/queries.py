"""Registered queries: name to (spark, sf_dir) -> DataFrame. Floating results are rounded to four places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketclime.functions import agronomy, calendar, text
from marketclime.operators import climate, ingest, names, prices, profiles, quality, water, yields
from marketclime.session import cut_lineage, scratch_path
from marketclime.sources import pages, reference, sinks, state
from marketclime.sources import prices as prices_source
from marketclime.sources import weather as weather_source
from marketclime.streaming import ingest as streams
from standin import views

FROST = (0.0, 2.0, 8.0)
BASE, CAP, FW, EFFICIENCY = 8.0, 30.0, 0.4, 0.9
SHORT_SWEEP = [(2, 15), (4, 15), (9, 1)]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# stage temperatures are short decimals that often end in a tie at six places
FINE = ("temp", "low", "high", "thermal_dev", "worst", "envelope")


def tidy(df: DataFrame, digits: int = 4, fine: int | None = None) -> DataFrame:
    """Round every double column; the ``FINE`` ones to ``fine`` digits if given."""

    def column(field):
        if not isinstance(field.dataType, T.DoubleType):
            return F.col(field.name)
        places = fine if fine and field.name.startswith(FINE) else digits
        return F.round(field.name, places).alias(field.name)

    return df.select(*[column(f) for f in df.schema])


def clean(spark, sf_dir):
    return quality.clean_prices(views.observations(spark, sf_dir))


def tags(spark, sf_dir):
    return reference.crop_tags(views.mapping(spark, sf_dir))


# ---------------------------------------------------------------- price quality


@query
def flag_duplicates(spark, sf_dir):
    flagged = quality.flag_duplicates(views.observations(spark, sf_dir))
    return flagged.select("date", "item", "ordinal", "duplicate")


@query
def duplicate_audit(spark, sf_dir):
    return quality.duplicate_audit(views.observations(spark, sf_dir))


@query
def conflicting_examples(spark, sf_dir):
    return tidy(quality.conflicting_examples(views.observations(spark, sf_dir)).drop("ordinal"))


@query
def column_order_audit(spark, sf_dir):
    return tidy(quality.column_order_audit(views.observations(spark, sf_dir)))


@query
def mad_thresholds(spark, sf_dir):
    return tidy(quality.mad_thresholds(views.observations(spark, sf_dir)), 3)


@query
def flag_outliers(spark, sf_dir):
    rows = views.observations(spark, sf_dir)
    return quality.flag_outliers(rows, k=2.0).select("date", "item", "ordinal", "outlier")


@query
def rolling_outliers(spark, sf_dir):
    rows = views.observations(spark, sf_dir)
    return quality.flag_local_outliers(rows, k=2.5).select("date", "item", "ordinal", "outlier")


@query
def missing_audit(spark, sf_dir):
    return quality.missing_audit(views.observations(spark, sf_dir))


@query
def clean_prices(spark, sf_dir):
    rows = clean(spark, sf_dir)
    return rows.select("date", "item", "ordinal", "order_ok", "outlier", "duplicate", "usable")


@query
def cleaning_summary(spark, sf_dir):
    return tidy(quality.cleaning_summary(clean(spark, sf_dir)))


@query
def apply_merges(spark, sf_dir):
    rows = quality.clean_prices(views.observations(spark, sf_dir), views.merges(spark, sf_dir))
    return rows.groupBy("item", "item_raw").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("usable").alias("usable"), F.sum("duplicate").alias("duplicates")
    )


@query
def first_row_distinct(spark, sf_dir):
    rows = quality.first_row_distinct(views.observations(spark, sf_dir))
    return rows.select("date", "item", "ordinal", "price_mode", "quantity")


# ---------------------------------------------------------------- price aggregates


@query
def weekly_prices(spark, sf_dir):
    return tidy(prices.weekly_prices(clean(spark, sf_dir)), 6)


@query
def seasonal_profile(spark, sf_dir):
    return tidy(prices.seasonal_profile(clean(spark, sf_dir)), 6)


@query
def series_index(spark, sf_dir):
    return tidy(prices.series_index(clean(spark, sf_dir), tags(spark, sf_dir)))


@query
def market_days(spark, sf_dir):
    return prices.market_days(clean(spark, sf_dir))


@query
def latest_snapshot(spark, sf_dir):
    return tidy(prices.latest_snapshot(clean(spark, sf_dir), tags(spark, sf_dir)))


# ---------------------------------------------------------------- item names and profiles


@query
def near_duplicate_pairs(spark, sf_dir):
    return tidy(names.near_duplicate_pairs(views.observations(spark, sf_dir)))


@query
def exact_name_groups(spark, sf_dir):
    return names.exact_name_groups(views.spelled_observations(spark, sf_dir))


@query
def item_profile(spark, sf_dir):
    profile = profiles.item_profile(views.observations(spark, sf_dir), views.mapping(spark, sf_dir))
    return tidy(profile.drop("first_ordinal"))


@query
def top_items(spark, sf_dir):
    profile = profiles.item_profile(views.observations(spark, sf_dir), views.mapping(spark, sf_dir))
    return profiles.top_items(profile, 30).select("item", "days_seen", "span")


@query
def mapping_coverage(spark, sf_dir):
    return profiles.mapping_coverage(views.observations(spark, sf_dir), views.mapping(spark, sf_dir))


@query
def crop_members(spark, sf_dir):
    members = reference.crop_members(views.mapping(spark, sf_dir))
    return members.select("crop_id", F.concat_ws("|", "members").alias("members"), "n")


@query
def parse_summary(spark, sf_dir):
    return profiles.parse_summary(views.observations(spark, sf_dir))


@query
def parse_report_units(spark, sf_dir):
    return profiles.unit_counts(views.observations(spark, sf_dir))


@query
def order_failures_by_year(spark, sf_dir):
    return profiles.order_failures_by_year(views.observations(spark, sf_dir))


@query
def failing_rows(spark, sf_dir):
    return tidy(profiles.failing_rows(views.observations(spark, sf_dir)))


@query
def days_per_year(spark, sf_dir):
    return profiles.days_per_year(views.observations(spark, sf_dir))


@query
def frequent_items(spark, sf_dir):
    return profiles.frequent_items(views.observations(spark, sf_dir))


# ---------------------------------------------------------------- climate


@query
def complete_years(spark, sf_dir):
    weather = views.weather(spark, sf_dir)
    return climate.complete_years(weather, ["tmax"])


@query
def monthly_climatology(spark, sf_dir):
    return tidy(climate.monthly_climatology(views.weather(spark, sf_dir)))


@query
def monthly_climatology_totals(spark, sf_dir):
    return tidy(climate.monthly_climatology_totals(views.weather(spark, sf_dir)))


@query
def heat_days(spark, sf_dir):
    return tidy(climate.heat_days(views.weather(spark, sf_dir), (30.0, 33.0, 35.0)))


@query
def hydro_rain(spark, sf_dir):
    return tidy(climate.hydro_rain(views.weather(spark, sf_dir)))


@query
def hydro_rain_distribution(spark, sf_dir):
    return tidy(climate.hydro_rain_distribution(climate.hydro_rain(views.weather(spark, sf_dir))))


@query
def extreme_seasons(spark, sf_dir):
    return tidy(climate.extreme_seasons(climate.hydro_rain(views.weather(spark, sf_dir)), 2))


@query
def frost_dates(spark, sf_dir):
    return climate.frost_dates(views.weather(spark, sf_dir), FROST)


@query
def frost_summary(spark, sf_dir):
    return tidy(climate.frost_summary(views.weather(spark, sf_dir), FROST))


@query
def gdd_days_to_target(spark, sf_dir):
    return tidy(climate.gdd_days_to_target(views.weather(spark, sf_dir), 3, 15, 10.0))


@query
def daily_payload(spark, sf_dir):
    return tidy(climate.daily_payload(views.weather(spark, sf_dir)))


@query
def weather_checks(spark, sf_dir):
    return tidy(climate.weather_checks(views.weather(spark, sf_dir)))


@query
def ingest_metadata(spark, sf_dir):
    return climate.ingest_metadata(views.weather(spark, sf_dir))


@query
def weather_merge(spark, sf_dir):
    return tidy(ingest.merge_weather(views.archive_rows(spark, sf_dir), views.recent_rows(spark, sf_dir)))


# ---------------------------------------------------------------- incremental ingest


@query
def missing_days(spark, sf_dir):
    rows = views.observations(spark, sf_dir).filter(F.dayofmonth("date") != 13)
    bounds = rows.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    return ingest.missing_days(bounds, rows, views.no_bulletin(spark, sf_dir))


@query
def wanted_days(spark, sf_dir):
    rows = views.observations(spark, sf_dir).filter(F.dayofmonth("date") % 4 != 1)
    today = rows.agg(F.date_add(F.max("date"), 3)).scalar()
    return ingest.wanted_days(today, rows, views.no_bulletin(spark, sf_dir), lookback=60, max_fetch=10)


@query
def unfetched_days(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders")
    bounds = orders.agg(
        F.min("o_orderdate").cast("date").alias("first"), F.max("o_orderdate").cast("date").alias("last")
    )
    return ingest.unfetched_days(bounds, views.checkpoint_entries(spark, sf_dir))


@query
def checkpoint_statuses(spark, sf_dir):
    return state.status_counts(views.checkpoint_entries(spark, sf_dir))


@query
def upsert_new_rows(spark, sf_dir):
    rows = views.observations(spark, sf_dir)
    stored = rows.filter(F.col("ordinal") % 3 != 0)
    batch = rows.filter(F.col("ordinal") % 3 == 0)
    merged = ingest.upsert_new_rows(stored, batch, dedupe_batch=True)
    return merged.select("date", "item", "ordinal", "price_mode")


@query
def observation_state(spark, sf_dir):
    table = ingest.observation_state(views.observations(spark, sf_dir), views.no_bulletin(spark, sf_dir))
    return table.select(
        "first", "last", "days_with_data", F.concat_ws(",", F.col("no_bulletin").cast("array<string>")).alias("absent")
    )


# ---------------------------------------------------------------- crop water demand


def water_setup(spark, sf_dir):
    weather = views.weather(spark, sf_dir)
    return weather, water.calibration_years(weather), views.crops(spark)


def seasons_of(spark, sf_dir, dates, **options):
    weather, years, variants = water_setup(spark, sf_dir)
    calibrated = water.calibrated_variants(weather, years, variants, BASE, CAP)
    return water.evaluate(calibrated, weather, years, dates, FW, EFFICIENCY, CAP, rain_fraction=0.5, **options)


@query
def reference_runs(spark, sf_dir):
    weather, years, variants = water_setup(spark, sf_dir)
    return tidy(water.reference_runs(weather, years, variants, [BASE], CAP), 6, fine=9)


@query
def gdd_requirement(spark, sf_dir):
    weather, years, variants = water_setup(spark, sf_dir)
    needs = water.gdd_requirement(water.reference_runs(weather, years, variants, [BASE], CAP))
    return tidy(
        needs.select(
            "site_id", "crop_id", "variant", "base", "years", *[F.col("requirement")[i].alias(f"need{i}") for i in range(4)]
        ),
        6,
        fine=9,
    )


@query
def thermal_envelope(spark, sf_dir):
    weather, years, variants = water_setup(spark, sf_dir)
    bounds = water.thermal_envelope(water.reference_runs(weather, years, variants, [BASE], CAP))
    return tidy(
        bounds.select(
            "site_id",
            "crop_id",
            "variant",
            "base",
            *[F.col("lowest")[i].alias(f"low{i}") for i in range(4)],
            *[F.col("highest")[i].alias(f"high{i}") for i in range(4)],
        ),
        6,
        fine=9,
    )


@query
def stage_lengths(spark, sf_dir):
    weather, years, variants = water_setup(spark, sf_dir)
    calibrated = water.calibrated_variants(weather, years, variants, BASE, CAP)
    candidates = water.planting_candidates(calibrated, years, SHORT_SWEEP)
    grown = water.stage_lengths(candidates, weather, years, CAP)
    return grown.select(*water.CANDIDATE, *water.STAGES)


SEASON_COLUMNS = [
    *water.CANDIDATE,
    "start",
    "end",
    "season_days",
    "et0_mm",
    "etc_mm",
    "rain_mm",
    "gross_mm",
    "kc_ini_used",
    "kc_mid_used",
    "kc_end_used",
    "u2_mid",
    "rhmin_mid",
    "frost_days",
    "coldest",
    "heat_days",
    "hottest",
    "thermal_ok",
    "thermal_worst",
    "thermal_dev",
]


def season_table(seasons):
    return tidy(
        seasons.select(
            *SEASON_COLUMNS,
            *[F.col("etc_by_stage")[i].alias(f"etc{i}") for i in range(4)],
            *[F.col("stage_temp")[i].alias(f"temp{i}") for i in range(4)],
        ),
        6,
        fine=9,
    )


@query
def season_run(spark, sf_dir):
    return season_table(seasons_of(spark, sf_dir, SHORT_SWEEP))


@query
def fixed_length_seasons(spark, sf_dir):
    return season_table(seasons_of(spark, sf_dir, SHORT_SWEEP, fixed_days=True))


@query
def planting_sweep(spark, sf_dir):
    return tidy(water.planting_sweep(seasons_of(spark, sf_dir, water.sweep_dates(15)), max_heat_days=20), 6, fine=9)


@query
def planting_summary(spark, sf_dir):
    return tidy(water.planting_summary(seasons_of(spark, sf_dir, [(4, 15)])), 6, fine=9)


@query
def gdd_sensitivity(spark, sf_dir):
    weather, years, variants = water_setup(spark, sf_dir)
    return tidy(water.gdd_sensitivity(weather, years, variants, (5.0, 10.0, 12.0), CAP))


# ---------------------------------------------------------------- yields


@query
def yield_summary(spark, sf_dir):
    return tidy(yields.yield_summary(views.yield_crops(spark, sf_dir), views.yield_rows(spark, sf_dir)))


# ---------------------------------------------------------------- pages, payloads, parameters


@query
def page_rows(spark, sf_dir):
    rows = pages.bulletin_rows(views.pages(spark, sf_dir))
    return rows.select(
        "date", "item", "unit", "price_low", "price_mode", "price_high", "quantity", "order_ok", "source_file"
    )


@query
def headed_page_rows(spark, sf_dir):
    """Rows of pages with a head, scripts and comments."""
    rows = pages.bulletin_rows(views.headed_pages(spark, sf_dir))
    return rows.select(
        "date", "item", "unit", "price_low", "price_mode", "price_high", "quantity", "order_ok", "source_file"
    )


@query
def page_parsers(spark, sf_dir):
    """How many pages with a head are cut natively; only unclosed cells need the HTML parser."""
    return pages.parser_counts(views.headed_pages(spark, sf_dir))


@query
def requested_page_rows(spark, sf_dir):
    rows = pages.requested_rows(views.pages(spark, sf_dir))
    return rows.select("date", "item", "unit", "price_low", "price_mode", "quantity")


@query
def page_counts(spark, sf_dir):
    return pages.page_counts(views.pages(spark, sf_dir).select("path", "html"))


@query
def bare_pages(spark, sf_dir):
    """The crawled pages have no bulletin table, so every page counts as empty."""
    crawled = views.table(spark, sf_dir, "pages").select(F.col("url").alias("path"), "html")
    counts = pages.page_counts(crawled)
    return counts.groupBy("row_count").agg(F.count(F.lit(1)).alias("pages"))


@query
def columnar_to_rows(spark, sf_dir):
    rows = weather_source.payload_rows(
        views.payloads(spark, sf_dir), ["temperature_2m_max", "precipitation_sum", "rain_sum"], keep=["vec_id"]
    )
    return tidy(rows, 6)


@query
def crop_listing(spark, sf_dir):
    return reference.crop_listing(views.crop_documents(spark, sf_dir))


@query
def crop_variants(spark, sf_dir):
    rows = reference.crop_variants(views.crop_documents(spark, sf_dir))
    return tidy(rows.withColumn("months", F.concat_ws(",", F.col("months").cast("array<string>"))))


@query
def cell_values(spark, sf_dir):
    cells = views.raw_cells(spark, sf_dir)
    return cells.select("ordinal", text.to_number(F.col("number")).alias("number"), text.to_date_any(F.col("day")).alias("day"))


@query
def calendar_keys(spark, sf_dir):
    days = views.table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("date")).distinct()
    day = F.col("date")
    return days.select(
        "date",
        calendar.week_key(day).alias("week"),
        calendar.week_start(calendar.week_key(day)).alias("week_start"),
        calendar.week_of_year(day).alias("week_of_year"),
        calendar.hydro_year(day).alias("hydro_year"),
        calendar.month_key(day).alias("month"),
        calendar.day_label(F.dayofyear(day)).alias("label"),
        calendar.is_trading_day(day).alias("open"),
    )


@query
def agronomy_terms(spark, sf_dir):
    weather = views.weather(spark, sf_dir)
    tmin, tmax = F.col("tmin"), F.col("tmax")
    u2, rh = agronomy.wind_at_2m(F.col("wind_max")), agronomy.rh_min(tmin, tmax)
    number = F.dayofyear("date") % 150
    kc_mid = agronomy.adjust_kc(F.lit(1.05), u2, rh, F.lit(0.7))
    stages = [F.lit(n) for n in (25, 35, 60, 30)]
    return tidy(
        weather.select(
            "site_id",
            "date",
            agronomy.saturation_vapour_pressure(tmax).alias("svp"),
            u2.alias("u2"),
            rh.alias("rh"),
            kc_mid.alias("kc_mid"),
            agronomy.kc_on_day(number, *stages, F.lit(0.24), F.lit(1.05), F.lit(0.9)).alias("kc"),
            agronomy.degree_days(tmin, tmax, 8.0, 30.0).alias("gdd"),
            agronomy.gross_irrigation(F.col("et0"), F.col("precip"), 0.5, 0.9).alias("gross"),
        ),
        6,
    )


# ---------------------------------------------------------------- outputs


@query
def month_store(spark, sf_dir):
    """Rows written by month and two months read back."""
    path = scratch_path(spark, "months")
    sinks.write_month_store(quality.first_row_distinct(views.observations(spark, sf_dir)), path)
    back = prices_source.read_month_store(spark, path, ["1996-02", "1999-11"])
    return back.select("date", "item", "ordinal", "price_mode", F.col("month").cast("string").alias("month"))


@query
def series_payload(spark, sf_dir):
    cleaned = cut_lineage(clean(spark, sf_dir), "clean")
    index = prices.series_index(cleaned, tags(spark, sf_dir))
    payload = sinks.series_payload(index, prices.weekly_prices(cleaned), prices.seasonal_profile(cleaned))
    first = F.col("weekly")[0]
    return payload.select(
        "series_id",
        "name",
        F.size("weekly").alias("weeks"),
        F.size("seasonal").alias("seasons"),
        first["week_start"].alias("first_week"),
        first["n"].alias("first_n"),
    )


# ---------------------------------------------------------------- streams


@query
def stream_weekly_counts(spark, sf_dir):
    table, checkpoint = scratch_path(spark, "weekly"), scratch_path(spark, "progress")
    counts = streams.weekly_counts(views.stream_events(spark, sf_dir), "ts", "event_type", "price_mode")
    streams.publish_weekly(counts, table, checkpoint, "event_type")
    weekly = spark.read.parquet(table)
    return tidy(weekly.select("week_start", "event_type", "n", "total", "lowest", "highest"))


@query
def stream_dedup_ingest(spark, sf_dir):
    store, checkpoint = scratch_path(spark, "store"), scratch_path(spark, "progress")
    rows = views.stream_events(spark, sf_dir).select("ordinal", "date", "item", "price_mode")
    streams.ingest_observations(rows, store, checkpoint)
    return spark.read.parquet(store).select("date", "item", "ordinal", "price_mode")


@query
def stream_recent_keys(spark, sf_dir):
    table, checkpoint = scratch_path(spark, "keys"), scratch_path(spark, "progress")
    recent = streams.dedup_recent(views.stream_events(spark, sf_dir)).select("date", "item")
    writer = recent.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("date date, item string").parquet(table)


@query
def stream_weather_merge(spark, sf_dir):
    table, checkpoint = scratch_path(spark, "weather"), scratch_path(spark, "progress")
    events = views.stream_events(spark, sf_dir)
    rows = events.select(
        F.regexp_extract("item", "([0-9]+)", 1).cast("long").alias("site_id"),
        "date",
        F.col("price_mode").alias("tmax"),
        F.when(F.col("event_type") == "purchase", "era5_archive").otherwise("preliminary").alias("source"),
        "ordinal",
    )
    streams.ingest_weather(rows, table, checkpoint)
    return spark.read.parquet(table).select("site_id", "date", "tmax", "source")


@query
def stream_page_ingest(spark, sf_dir):
    folder, store = scratch_path(spark, "pages"), scratch_path(spark, "store")
    views.pages(spark, sf_dir).write.parquet(folder)
    arriving = spark.readStream.schema("path string, html string, expected date").parquet(folder)
    streams.ingest_pages(arriving, store, scratch_path(spark, "progress"))
    return spark.read.parquet(store).select("date", "item", "unit", "price_low", "price_mode", "quantity")
