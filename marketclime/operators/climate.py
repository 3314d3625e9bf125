"""Climate statistics per site from one weather row per (site, date)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketclime.functions.agronomy import degree_days, reached
from marketclime.functions.calendar import date_of, day_label, hydro_year
from marketclime.functions.text import month_label

SETTLED = "era5_archive"
MIN_YEAR_DAYS = 360
FROST_THRESHOLDS = (0.0, 2.0, 4.0)
HEAT_THRESHOLDS = (35.0, 38.0, 40.0)
GDD_TARGETS = (400, 800, 1200, 1600, 2000)


def settled_days(weather: DataFrame) -> DataFrame:
    """Days the archive has settled; the preliminary tail is left out."""
    return weather.filter(F.col("source") == SETTLED)


def complete_years(weather: DataFrame, require: Sequence[str] = (), min_days: int = MIN_YEAR_DAYS) -> DataFrame:
    """(site_id, year) with enough settled days on which every column of ``require`` is known."""
    days = settled_days(weather)
    for column in require:
        days = days.filter(F.col(column).isNotNull())
    counts = days.groupBy("site_id", F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("days"))
    return counts.filter(F.col("days") >= min_days)


def usable_days(weather: DataFrame, years: DataFrame) -> DataFrame:
    """Settled days of complete years, with their year and month."""
    days = settled_days(weather).select("*", F.year("date").alias("year"), F.month("date").alias("month"))
    return days.join(years.select("site_id", "year"), ["site_id", "year"], "left_semi")


def _year_count(years: DataFrame) -> DataFrame:
    return years.groupBy("site_id").agg(F.count(F.lit(1)).alias("years"))


def monthly_climatology(weather: DataFrame, min_days: int = MIN_YEAR_DAYS) -> DataFrame:
    """Twelve rows per site: mean temperatures, rain, ET0 and frost nights per complete year.

    Settled days without tmax do not count; missing rain and ET0 count as zero.
    """
    years = complete_years(weather, ["tmax"], min_days)
    months = _year_count(years).select("site_id", "years", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    days = usable_days(weather.filter(F.col("tmax").isNotNull()), years)
    totals = days.groupBy("site_id", "month").agg(
        F.avg("tmax").alias("tmax"),
        F.avg("tmin").alias("tmin"),
        F.sum(F.coalesce("precip", F.lit(0.0))).alias("_rain"),
        F.sum(F.coalesce("et0", F.lit(0.0))).alias("_et0"),
        F.count_if(F.col("tmin") <= 0).alias("_frost"),
    )
    return months.join(totals, ["site_id", "month"], "left").select(
        "site_id",
        "month",
        "tmax",
        "tmin",
        (F.col("_rain") / F.col("years")).alias("rain"),
        (F.col("_et0") / F.col("years")).alias("et0"),
        (F.col("_frost") / F.col("years")).alias("frost_nights"),
    )


def monthly_climatology_totals(weather: DataFrame, min_days: int = MIN_YEAR_DAYS) -> DataFrame:
    """Twelve rows per site: mean daily temperatures and the mean over complete years of monthly totals.

    A year without a value in a month adds zero to the mean, so the mean is
    the grand total over the number of years. Missing values are skipped.
    """
    years = complete_years(weather, min_days=min_days)
    months = _year_count(years).select("site_id", "years", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    totals = (
        usable_days(weather, years)
        .groupBy("site_id", "month")
        .agg(
            F.avg("tmax").alias("tmax_mean_c"),
            F.avg("tmin").alias("tmin_mean_c"),
            F.sum("precip").alias("_rain"),
            F.sum("et0").alias("_et0"),
        )
    )
    return months.join(totals, ["site_id", "month"], "left").select(
        "site_id",
        "month",
        month_label(F.col("month")).alias("label"),
        "tmax_mean_c",
        "tmin_mean_c",
        (F.coalesce("_rain", F.lit(0.0)) / F.col("years")).alias("rain_mean_mm"),
        (F.coalesce("_et0", F.lit(0.0)) / F.col("years")).alias("et0_mean_mm"),
    )


def heat_days(
    weather: DataFrame, thresholds: Sequence[float] = HEAT_THRESHOLDS, min_days: int = MIN_YEAR_DAYS
) -> DataFrame:
    """Days per complete year at or above each threshold, by site and month."""
    years = complete_years(weather, min_days=min_days)
    levels = F.array(*[F.lit(float(t)) for t in thresholds])
    cells = (
        _year_count(years)
        .select("site_id", "years", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
        .select("*", F.explode(levels).alias("threshold"))
    )
    hot = (
        usable_days(weather, years)
        .filter(F.col("tmax") >= min(thresholds))
        .select("site_id", "month", "tmax", F.explode(levels).alias("threshold"))
        .filter(F.col("tmax") >= F.col("threshold"))
        .groupBy("site_id", "month", "threshold")
        .agg(F.count(F.lit(1)).alias("_hot"))
    )
    per_year = F.coalesce("_hot", F.lit(0)) / F.col("years")
    return cells.join(hot, ["site_id", "month", "threshold"], "left").select(
        "site_id", "month", "threshold", per_year.alias("days_per_year")
    )


def hydro_rain(
    weather: DataFrame, null_as_zero: bool = False, require: Sequence[str] = (), min_days: int = MIN_YEAR_DAYS
) -> DataFrame:
    """October to September rain totals of seasons with enough days.

    With ``null_as_zero`` every day counts and missing rain adds nothing;
    otherwise days without rain data do not count.
    """
    days = settled_days(weather)
    for column in require:
        days = days.filter(F.col(column).isNotNull())
    if not null_as_zero:
        days = days.filter(F.col("precip").isNotNull())
    return (
        days.groupBy("site_id", hydro_year(F.col("date")).alias("season"))
        .agg(F.sum(F.coalesce("precip", F.lit(0.0))).alias("rain_mm"), F.count(F.lit(1)).alias("days"))
        .filter(F.col("days") >= min_days)
    )


def hydro_rain_distribution(seasons: DataFrame) -> DataFrame:
    """Driest, quartiles and wettest season per site."""
    quartiles = F.percentile("rain_mm", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (
        seasons.groupBy("site_id")
        .agg(
            F.count(F.lit(1)).alias("seasons"),
            F.min("rain_mm").alias("driest"),
            quartiles.alias("_q"),
            F.max("rain_mm").alias("wettest"),
        )
        .select(
            "site_id",
            "seasons",
            "driest",
            F.col("_q")[0].alias("p25"),
            F.col("_q")[1].alias("median"),
            F.col("_q")[2].alias("p75"),
            "wettest",
        )
    )


def extreme_seasons(seasons: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` driest and the ``n`` wettest seasons of each site, with their rank from the dry end.

    A site has at most one season per year, so its window is small.
    """
    by_rain = Window.partitionBy("site_id").orderBy("rain_mm", "season")
    ranked = seasons.select(
        "site_id",
        "season",
        "rain_mm",
        F.row_number().over(by_rain).alias("place"),
        F.count(F.lit(1)).over(Window.partitionBy("site_id")).alias("_n"),
    )
    driest = ranked.filter(F.col("place") <= n).withColumn("end", F.lit("driest"))
    wettest = ranked.filter(F.col("place") > F.col("_n") - n).withColumn("end", F.lit("wettest"))
    return driest.unionByName(wettest).drop("_n")


def frost_dates(
    weather: DataFrame, thresholds: Sequence[float] = FROST_THRESHOLDS, min_days: int = MIN_YEAR_DAYS
) -> DataFrame:
    """Last spring (January to June) and first autumn (July to December) frost day per site, year, threshold."""
    years = complete_years(weather, min_days=min_days)
    levels = F.array(*[F.lit(float(t)) for t in thresholds])
    cold = (
        usable_days(weather, years)
        .filter(F.col("tmin") <= max(thresholds))
        .select("site_id", "year", "month", "tmin", F.dayofyear("date").alias("doy"), F.explode(levels).alias("threshold"))
        .filter(F.col("tmin") <= F.col("threshold"))
    )
    return cold.groupBy("site_id", "year", "threshold").agg(
        F.max(F.when(F.col("month") <= 6, F.col("doy"))).alias("last_spring_doy"),
        F.min(F.when(F.col("month") >= 7, F.col("doy"))).alias("first_autumn_doy"),
    )


def frost_summary(
    weather: DataFrame, thresholds: Sequence[float] = FROST_THRESHOLDS, min_days: int = MIN_YEAR_DAYS
) -> DataFrame:
    """Frost windows over complete years, one row per site and threshold."""
    levels = F.array(*[F.lit(float(t)) for t in thresholds])
    sites = _year_count(complete_years(weather, min_days=min_days)).select(
        "site_id", F.col("years").alias("complete_years"), F.explode(levels).alias("threshold")
    )
    spring, autumn = F.col("last_spring_doy"), F.col("first_autumn_doy")
    free = autumn - spring
    summary = (
        frost_dates(weather, thresholds, min_days)
        .groupBy("site_id", "threshold")
        .agg(
            F.percentile(spring, F.array(F.lit(0.5), F.lit(0.9))).alias("_spring"),
            F.max(spring).alias("spring_max"),
            F.percentile(autumn, F.array(F.lit(0.5), F.lit(0.1))).alias("_autumn"),
            F.min(autumn).alias("autumn_min"),
            F.count(spring).alias("_spring_years"),
            F.count(autumn).alias("_autumn_years"),
            F.median(free).alias("frost_free_median"),
            F.min(free).alias("frost_free_min"),
            F.max(free).alias("frost_free_max"),
        )
    )
    return sites.join(summary, ["site_id", "threshold"], "left").select(
        "site_id",
        "threshold",
        "complete_years",
        F.col("_spring")[0].alias("spring_p50"),
        F.col("_spring")[1].alias("spring_p90"),
        "spring_max",
        F.col("_autumn")[0].alias("autumn_p50"),
        F.col("_autumn")[1].alias("autumn_p10"),
        "autumn_min",
        F.coalesce("_spring_years", F.lit(0)).alias("spring_years"),
        F.coalesce("_autumn_years", F.lit(0)).alias("autumn_years"),
        "frost_free_median",
        "frost_free_min",
        "frost_free_max",
        day_label(F.col("_spring")[1]).alias("spring_p90_label"),
        day_label(F.col("_autumn")[1]).alias("autumn_p10_label"),
    )


def gdd_hits(
    weather: DataFrame,
    month: int,
    day: int,
    base: float = 10.0,
    targets: Sequence[float] = GDD_TARGETS,
    min_days: int = MIN_YEAR_DAYS,
) -> DataFrame:
    """Days from the start date until each heat total is reached, per site, year and target.

    Only days of complete years are seen and missing days are skipped, so a
    sum that runs into an incomplete year just stops there. Each day belongs
    to at most two start years; the running sum is over one year of one site.
    """
    years = complete_years(weather, min_days=min_days)
    days = usable_days(weather, years).filter(F.col("tmin").isNotNull() & F.col("tmax").isNotNull())
    anchored = days.select(
        "site_id",
        "date",
        degree_days(F.col("tmin"), F.col("tmax"), float(base)).alias("gdd"),
        F.explode(F.array(F.col("year"), F.col("year") - 1)).alias("start_year"),
    )
    start = date_of(F.col("start_year"), F.lit(month), F.lit(day))
    offset = F.datediff("date", start)
    starts = years.select("site_id", F.col("year").alias("start_year"))
    running = Window.partitionBy("site_id", "start_year").orderBy("offset")
    summed = (
        anchored.select("*", offset.alias("offset"))
        .filter((F.col("offset") >= 0) & (F.col("offset") < 365))
        .join(starts, ["site_id", "start_year"], "left_semi")
        .select(
            "site_id",
            "start_year",
            "offset",
            F.sum("gdd").over(running.rowsBetween(Window.unboundedPreceding, 0)).alias("total"),
        )
    )
    first_days = [F.min(F.when(reached(F.col("total"), t), F.col("offset") + 1)).alias(f"_t{i}") for i, t in enumerate(targets)]
    cells = F.array(
        *[F.struct(F.lit(float(t)).alias("target"), F.col(f"_t{i}").alias("days")) for i, t in enumerate(targets)]
    )
    per_year = summed.groupBy("site_id", "start_year").agg(*first_days)
    return per_year.select("site_id", "start_year", F.inline(cells)).filter(F.col("days").isNotNull())


def gdd_days_to_target(weather: DataFrame, month: int, day: int, base: float = 10.0, **options) -> DataFrame:
    """Median, fastest and slowest days to each heat total over the years that reach it."""
    hits = gdd_hits(weather, month, day, base, **options)
    return hits.groupBy("site_id", "target").agg(
        F.median("days").alias("median_days"),
        F.min("days").alias("fastest"),
        F.max("days").alias("slowest"),
        F.count(F.lit(1)).alias("years"),
    )


def daily_payload(weather: DataFrame) -> DataFrame:
    """Compact daily series: epoch day, temperatures, rain and ET0 with gaps as zero, settled flag."""
    return weather.filter(F.col("tmax").isNotNull()).select(
        "site_id",
        F.unix_date("date").alias("epoch_day"),
        "tmax",
        "tmin",
        F.coalesce("precip", F.lit(0.0)).alias("rain_mm"),
        F.coalesce("et0", F.lit(0.0)).alias("et0_mm"),
        (F.col("source") == SETTLED).cast("int").alias("settled"),
    )


def weather_checks(weather: DataFrame) -> DataFrame:
    """Sanity figures per site: coldest night, frost days per year, annual rain without the first year.

    The middle of an even number of years is the upper one. A site has one
    rain total per year, so the sorted array is small.
    """
    settled = settled_days(weather)
    cold = settled.groupBy("site_id").agg(
        F.min("tmin").alias("min_tmin"),
        F.count_if(F.col("tmin") <= 0).alias("frost_days"),
        F.count_distinct(F.year("date")).alias("years"),
    )
    first = weather.groupBy("site_id").agg(F.year(F.min("date")).alias("_first_year"))
    rain = (
        settled.filter(F.col("precip").isNotNull())
        .groupBy("site_id", F.year("date").alias("year"))
        .agg(F.sum("precip").alias("rain"))
        .join(first, "site_id")
        .filter(F.col("year") != F.col("_first_year"))
        .groupBy("site_id")
        .agg(F.sort_array(F.collect_list("rain")).alias("_rain"))
    )
    middle = F.floor(F.size("_rain") / 2).cast("int")
    return cold.join(rain, "site_id", "left").select(
        "site_id",
        "min_tmin",
        "frost_days",
        "years",
        (F.col("frost_days") / F.col("years")).alias("frost_days_per_year"),
        F.array_min("_rain").alias("rain_min"),
        F.try_element_at("_rain", middle + 1).alias("rain_median"),
        F.array_max("_rain").alias("rain_max"),
    )


def ingest_metadata(weather: DataFrame) -> DataFrame:
    """Row counts and the last archive date per site."""
    is_settled = F.col("source") == SETTLED
    return weather.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(is_settled).alias("settled"),
        F.count_if(~is_settled).alias("preliminary"),
        F.max(F.when(is_settled, F.col("date"))).alias("archive_last_date"),
        F.min("date").alias("first"),
        F.max("date").alias("last"),
    )
