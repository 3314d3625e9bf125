"""Crop water demand over many sites, crops, planting dates and years.

Weather is laid out as one array of days per (site, start year), long enough
for the longest season that may start in that year, and candidates meet their
block by an equi-join on (site, year); after that no step shuffles weather again.

Shared columns:

* ``variants`` (see ``sources.reference.crop_variants``): crop_id, variant,
  stage lengths ini/dev/mid/late, months, Kc values, height, heat_threshold;
* ``weather``: one row per (site_id, date); ``ingest.last_row_per_day`` makes it so;
* ``years``: site_id, year of complete years;
* candidates: site_id, year, crop_id, variant, month, day and stage lengths.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketclime.functions.agronomy import (
    adjust_kc,
    degree_days,
    gross_irrigation,
    kc_on_day,
    mean_temperature,
    reached,
    rh_min,
    stage_of_day,
    volume_m3,
    wind_at_2m,
)
from marketclime.functions.calendar import date_of, day_label
from marketclime.operators.climate import complete_years
from marketclime.session import cut_lineage

MAX_SEASON_DAYS = 400  # fixed value: a heat-driven season that has not ended by then has no length
_NEVER = 1 << 30  # a place beyond all days
STAGES = ("ini", "dev", "mid", "late")
STAGE_NAMES = ("initial", "development", "mid-season", "late")
SENSITIVITY_BASES = (5.0, 8.0, 10.0, 12.0, 15.0)
CANDIDATE = ("site_id", "year", "crop_id", "variant", "month", "day")


def calibration_years(weather: DataFrame, min_days: int = 360) -> DataFrame:
    """Complete years for water work: enough settled days with ET0. Written out, as every later step uses it."""
    return cut_lineage(complete_years(weather, ["et0"], min_days).select("site_id", "year"), "years")


def _season_rows(weather: DataFrame, years: DataFrame, longest: int) -> DataFrame:
    """A row per (site, start year) and day that seasons of up to ``longest`` days may reach."""
    last = 365 + max(longest, 1) - 1  # of a season planted on the last day of a leap year
    wind = F.coalesce("wind_mean", "wind_max")
    days = weather.select(
        "site_id",
        "date",
        "tmin",
        "tmax",
        "et0",
        "precip",
        wind_at_2m(wind).alias("u2"),
        rh_min(F.col("tmin"), F.col("tmax")).alias("rh"),
        F.explode(F.array(*[F.year("date") - back for back in range(last // 365 + 1)])).alias("year"),
    )
    k = F.datediff("date", date_of(F.col("year"), F.lit(1), F.lit(1)))
    return days.withColumn("k", k).filter(F.col("k") <= last).join(years, ["site_id", "year"], "left_semi")


def season_blocks(weather: DataFrame, years: DataFrame, longest: int) -> DataFrame:
    """Per (site, start year), the days that seasons of up to ``longest`` days may reach, in date order.

    Day ``k`` counts from 1 January of the start year. Weather is not limited
    to settled days or complete years; only start years are.
    """
    days = F.collect_list(F.struct("k", "tmin", "tmax", "et0", "precip", "u2", "rh"))
    return _season_rows(weather, years, longest).groupBy("site_id", "year").agg(F.sort_array(days).alias("days"))


def heat_sums(
    weather: DataFrame, years: DataFrame, bases: DataFrame, longest: int, cap: float | None = None
) -> DataFrame:
    """Per (site, start year, base) of ``bases``: running heat sums, one place per day.

    ``first_k`` is the day of the first place; each holds the ``heat`` and the
    number of ``known`` days up to it. A missing day has a place too and adds
    to neither, so heat never falls along the array and a gap shows in
    ``known``.
    """
    by_day = Window.partitionBy("site_id", "year", "base").orderBy("k")
    gdd = degree_days(F.col("tmin"), F.col("tmax"), F.col("base"), cap)
    summed = (
        _season_rows(weather, years, longest)
        .join(bases, ["site_id", "year"])
        .select("site_id", "year", "base", "k", gdd.alias("gdd"))
        .select(
            "site_id",
            "year",
            "base",
            F.coalesce(F.sum("gdd").over(by_day), F.lit(0.0)).alias("heat"),
            F.count("gdd").over(by_day).cast("int").alias("known"),
            F.col("k").alias("from_k"),
            F.coalesce(F.lead("k").over(by_day) - 1, F.col("k")).alias("to_k"),
        )
        .select("site_id", "year", "base", "heat", "known", F.explode(F.sequence("from_k", "to_k")).alias("k"))
    )
    places = F.sort_array(F.collect_list(F.struct("k", "heat", "known")))
    return summed.groupBy("site_id", "year", "base").agg(F.min("k").alias("first_k"), places.alias("sums"))


def _every_variant(years: DataFrame, variants: DataFrame) -> DataFrame:
    """Each site-year with each variant, as is wanted of a calibration.

    Site-years are dealt to parts and every part meets a copy of the variants,
    so neither table is gathered in one place, whatever its size.
    """
    parts = int(years.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = years.withColumn("_part", F.pmod(F.xxhash64("site_id", "year"), F.lit(parts)).cast("int"))
    copies = variants.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt.join(copies, "_part").drop("_part")


def _longest(df: DataFrame) -> int:
    """The largest sum of stage lengths; 0 for an empty table."""
    return df.agg(F.max(_total([F.col(s) for s in STAGES]))).first()[0] or 0


def _total(lengths: Sequence[Column]) -> Column:
    return sum(lengths[1:], lengths[0])


def _start_offset() -> Column:
    """Planting day as an offset from 1 January of its year; null where the day does not exist."""
    start = date_of(F.col("year"), F.col("month"), F.col("day"))
    return F.datediff(start, date_of(F.col("year"), F.lit(1), F.lit(1)))


def _dated(candidates: DataFrame) -> DataFrame:
    """Candidates whose planting day exists, with its ``start_k``, dealt by site and year.

    They are few bytes but much work, so their spread must not shrink with their size.
    """
    tasks = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dated = candidates.withColumn("start_k", _start_offset()).filter(F.col("start_k").isNotNull())
    return dated.repartition(tasks, "site_id", "year")


def _season_days(candidates: DataFrame, blocks: DataFrame, longest: Column) -> DataFrame:
    """Attach the days of each candidate's season, ``longest`` days from planting."""
    met = _dated(candidates).join(blocks, ["site_id", "year"])
    first = F.get("days", F.lit(0))["k"]
    last = F.get("days", F.size("days") - 1)["k"]
    # a block without gaps is cut by position, any other by day number
    by_place = F.slice("days", F.greatest(F.col("start_k") - first, F.lit(0)) + 1, F.greatest(longest, F.lit(0)))
    by_number = F.filter("days", lambda d: (d["k"] >= F.col("start_k")) & (d["k"] < F.col("start_k") + longest))
    whole = (last - first + 1 == F.size("days")) & (F.col("start_k") >= first)
    return met.withColumn("days", F.when(whole, by_place).otherwise(by_number))


# ------------------------------------------------------------ calibration


def reference_runs(
    weather: DataFrame,
    years: DataFrame,
    variants: DataFrame,
    bases: Sequence[float] = (10.0,),
    cap: float | None = None,
) -> DataFrame:
    """Published stage lengths run from mid-month of each published planting month, every complete year.

    Heat sum (``gdd0..3``) and mean temperature (``temp0..3``) per stage and
    base temperature; a run with a missing day is left out.
    """
    runs = (
        _every_variant(years, variants)
        .select("site_id", "year", "crop_id", "variant", *STAGES, F.posexplode("months").alias("month_rank", "month"))
        .withColumn("day", F.lit(15))
    )
    lengths = [F.col(s) for s in STAGES]
    total = _total(lengths)
    days = _season_days(runs, season_blocks(weather, years, _longest(variants)), total).select(
        *CANDIDATE, *STAGES, "month_rank", "start_k", F.inline_outer("days")
    )
    stage = stage_of_day(F.col("k") - F.col("start_k") + 1, *lengths[:3])
    warmth = mean_temperature(F.col("tmin"), F.col("tmax"))
    based = days.select(
        "*", stage.alias("stage"), warmth.alias("warmth"), F.explode(F.array(*[F.lit(float(b)) for b in bases])).alias("base")
    ).withColumn("gdd", degree_days(F.col("tmin"), F.col("tmax"), F.col("base"), cap))
    aggregates = [F.count("gdd").alias("_known")]
    for i in range(4):
        here = F.col("stage") == i
        aggregates.append(F.coalesce(F.sum(F.when(here, F.col("gdd"))), F.lit(0.0)).alias(f"gdd{i}"))
        aggregates.append(F.avg(F.when(here, F.col("warmth"))).alias(f"temp{i}"))
    return (
        based.groupBy(*CANDIDATE, *STAGES, "month_rank", "base")
        .agg(*aggregates)
        .filter(F.col("_known") == total)
        .drop("_known", "day", *STAGES)
    )


def gdd_requirement(runs: DataFrame) -> DataFrame:
    """Mean heat sum per stage over the years, from each variant's first planting month."""
    return (
        runs.filter(F.col("month_rank") == 0)
        .groupBy("site_id", "crop_id", "variant", "base")
        .agg(F.array(*[F.avg(f"gdd{i}") for i in range(4)]).alias("requirement"), F.count(F.lit(1)).alias("years"))
    )


def thermal_envelope(runs: DataFrame, pool: bool = True) -> DataFrame:
    """Lowest and highest stage temperature over the reference runs of each chosen variant.

    The chosen variant contributes its first planting month only; with
    ``pool`` the crop's other variants contribute all of theirs.
    """
    chosen = runs.filter(F.col("month_rank") == 0).select(
        "site_id", "crop_id", "base", F.col("variant").alias("chosen")
    )
    pairs = runs.join(chosen.distinct(), ["site_id", "crop_id", "base"])
    own = (F.col("variant") == F.col("chosen")) & (F.col("month_rank") == 0)
    other = (F.col("variant") != F.col("chosen")) if pool else F.lit(False)
    return (
        pairs.filter(own | other)
        .groupBy("site_id", "crop_id", "base", F.col("chosen").alias("variant"))
        .agg(
            F.array(*[F.min(f"temp{i}") for i in range(4)]).alias("lowest"),
            F.array(*[F.max(f"temp{i}") for i in range(4)]).alias("highest"),
        )
    )


def calibrated_variants(
    weather: DataFrame,
    years: DataFrame,
    variants: DataFrame,
    base: float,
    cap: float | None = None,
    pool: bool = True,
) -> DataFrame:
    """Variants of each site with heat requirement and thermal envelope; uncalibrated ones drop out."""
    runs = cut_lineage(reference_runs(weather, years, variants, [base], cap), "reference-runs")
    keys = ["site_id", "crop_id", "variant", "base"]
    limits = gdd_requirement(runs).join(thermal_envelope(runs, pool), keys)
    limits = limits.withColumnRenamed("years", "reference_years").join(variants, ["crop_id", "variant"])
    return cut_lineage(limits, "calibration")


# ------------------------------------------------------------ season length


def _stage_lengths(start: Column, needs: Column, max_days: int) -> Column:
    """Days each needed stage takes to gather its heat; null if a day is missing or the season never ends.

    ``start`` is the planting day's place in ``sums``. A stage ends at the first
    place whose heat exceeds that before the stage by its need, found by
    halving; what it gathers beyond its need is not carried over. ``needs``
    holds positive needs only.
    """
    sums = F.col("sums")
    beyond = F.least(F.size(sums), start + max_days)

    def upto(place: Column, field: str) -> Column:
        return F.when(place > 0, F.get(sums, place - 1)[field]).otherwise(0)

    def state(at: Column, lengths: Column) -> Column:
        return F.struct(at.alias("at"), lengths.alias("lengths"))

    def stage(now: Column, need: Column) -> Column:
        def halve(span: Column, _: Column) -> Column:
            middle = F.floor((span["low"] + span["high"]) / 2).cast("int")
            full = reached(F.get(sums, middle)["heat"] - upto(now["at"], "heat"), need)
            return (
                F.when(span["low"] >= span["high"], span)
                .when(full, F.struct(span["low"].alias("low"), middle.alias("high")))
                .otherwise(F.struct((middle + 1).alias("low"), span["high"].alias("high")))
            )

        halvings = F.sequence(F.lit(1), F.lit(max_days.bit_length() + 1))
        span = F.struct(now["at"].alias("low"), F.greatest(now["at"], beyond).alias("high"))
        found = F.aggregate(halvings, span, halve, lambda end: end["low"])
        # a stage that never ends leaves a place beyond all days
        stop = F.when(now["at"] >= beyond, F.lit(_NEVER)).otherwise(F.least(found + 1, F.lit(_NEVER)))
        stop = F.when(stop > beyond, F.lit(_NEVER)).otherwise(stop)
        return F.transform(F.array(stop), lambda x: state(x, F.concat(now["lengths"], F.array(x - now["at"]))))[0]

    def whole(end: Column) -> Column:
        return (end["at"] < _NEVER) & (upto(end["at"], "known") - upto(start, "known") == end["at"] - start)

    grown = F.aggregate(
        needs, state(start, F.array().cast("array<int>")), stage, lambda end: F.when(whole(end), end["lengths"])
    )
    none = F.array().cast("array<int>")
    return F.when(F.size(needs) == 0, none).when((start >= 0) & (start < F.size(sums)), grown)


def stage_lengths(
    candidates: DataFrame,
    weather: DataFrame,
    years: DataFrame,
    cap: float | None = None,
    max_days: int = MAX_SEASON_DAYS,
) -> DataFrame:
    """Stage lengths in days from the heat requirement, for every candidate that finishes within ``max_days``.

    Candidates carry ``requirement`` and ``base``. Stages without a need take
    no day: the search sees the positive needs only, and zeros are put back.
    Heat is summed once per site, start year and base, not per candidate.
    """
    bases = candidates.select("site_id", "year", "base").distinct()
    met = _dated(candidates).join(heat_sums(weather, years, bases, max_days, cap), ["site_id", "year", "base"])
    kept = [c for c in met.columns if c not in ("sums", "first_k", "start_k", *STAGES)]
    start = (F.col("start_k") - F.col("first_k")).alias("_start")
    ready = met.select(*kept, start, "sums", F.filter("requirement", lambda n: n > 0).alias("_needs"))
    # an outer generator, so that no filter on the result runs the search again
    found = _stage_lengths(F.col("_start"), F.col("_needs"), max_days)
    grown = ready.select(*kept, F.explode_outer(F.array(found)).alias("_taken")).filter(F.col("_taken").isNotNull())
    need = [F.get("requirement", F.lit(i)) > 0 for i in range(4)]
    lengths = []
    for i, stage in enumerate(STAGES):
        place = sum((n.cast("int") for n in need[:i]), F.lit(0))
        lengths.append(F.when(need[i], F.get("_taken", place)).otherwise(F.lit(0)).alias(stage))
    return grown.select(*kept, *lengths)


# ------------------------------------------------------------ season run


def _mean_of(days: Column, field: str, first: Column, length: Column) -> Column:
    """Mean of a field over ``length`` season days from day ``first`` (from 0), nulls skipped.

    Cut by position: a season with a missing day is left out later anyway.
    """
    stage = F.slice(days, first + 1, length)
    known = F.filter(F.transform(stage, lambda d: d[field]), lambda v: v.isNotNull())
    mean = F.aggregate(
        known,
        F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")),
        lambda now, v: F.struct((now["s"] + v).alias("s"), (now["n"] + 1).alias("n")),
        lambda end: F.when(end["n"] > 0, end["s"] / end["n"]),
    )
    return mean


def season_run(
    candidates: DataFrame,
    weather: DataFrame,
    years: DataFrame,
    fw: float,
    efficiency: float,
    rain_fraction: float = 0.0,
    frost_threshold: float = 0.0,
    heat_threshold: float | None = None,
    longest: int | None = None,
) -> DataFrame:
    """Water balance and thermal record of each candidate season.

    Candidates carry stage lengths and the Kc columns. A season with a missing
    day or ET0 is left out. ``heat_threshold`` overrides the crop's own.
    ``longest`` is a bound on the seasons' days where one is known; without it
    the candidates are read for their longest season first.
    """
    ini, dev, mid, late = (F.col(s) for s in STAGES)
    total = ini + dev + mid + late
    blocks = season_blocks(weather, years, _longest(candidates) if longest is None else longest)
    seasons = _season_days(candidates, blocks, total).withColumn("season_days", total)

    days = F.col("days")
    # without late days the mid-season stands in for them
    late_from = ini + dev + F.when(late > 0, mid).otherwise(0)
    late_length = F.when(late > 0, late).otherwise(mid)
    heat = F.lit(float(heat_threshold)) if heat_threshold is not None else F.col("heat_threshold")
    keep = [c for c in candidates.columns if c not in CANDIDATE]
    seasons = seasons.select(
        *CANDIDATE,
        *keep,
        "season_days",
        "start_k",
        "days",
        _mean_of(days, "u2", ini + dev, mid).alias("u2_mid"),
        _mean_of(days, "rh", ini + dev, mid).alias("rhmin_mid"),
        _mean_of(days, "u2", late_from, late_length).alias("_u2_late"),
        _mean_of(days, "rh", late_from, late_length).alias("_rh_late"),
    )
    kc_end = F.when(
        F.col("kc_end") > 0.45, adjust_kc(F.col("kc_end"), F.col("_u2_late"), F.col("_rh_late"), F.col("height"))
    ).otherwise(F.col("kc_end"))
    seasons = seasons.select(
        "*",
        (fw * F.col("kc_ini")).alias("kc_ini_used"),
        adjust_kc(F.col("kc_mid"), F.col("u2_mid"), F.col("rhmin_mid"), F.col("height")).alias("kc_mid_used"),
        kc_end.alias("kc_end_used"),
        heat.alias("_heat"),
    )
    constants = [*keep, "season_days", "u2_mid", "rhmin_mid", "kc_ini_used", "kc_mid_used", "kc_end_used"]
    lived = seasons.select(*CANDIDATE, *constants, "_heat", "start_k", F.inline_outer("days"))
    number = F.col("k") - F.col("start_k") + 1
    kc = kc_on_day(number, ini, dev, mid, late, F.col("kc_ini_used"), F.col("kc_mid_used"), F.col("kc_end_used"))
    daily = lived.select(
        *CANDIDATE,
        *constants,
        "tmin",
        "tmax",
        "et0",
        "precip",
        (kc * F.col("et0")).alias("etc"),
        stage_of_day(number, ini, dev, mid).alias("stage"),
        mean_temperature(F.col("tmin"), F.col("tmax")).alias("warmth"),
        "_heat",
    )

    def by_stage(fn, column: str, default=None) -> Column:
        cells = [fn(F.when(F.col("stage") == i, F.col(column))) for i in range(4)]
        return F.array(*[F.coalesce(c, F.lit(default)) if default is not None else c for c in cells])

    # constants are functions of the candidate key, so any value of the group will do
    totals = daily.groupBy(*CANDIDATE).agg(
        *[F.first(c).alias(c) for c in constants],
        F.count("et0").alias("_known"),
        F.sum("et0").alias("et0_mm"),
        F.sum("etc").alias("etc_mm"),
        F.sum(F.coalesce("precip", F.lit(0.0))).alias("rain_mm"),
        by_stage(F.sum, "etc", 0.0).alias("etc_by_stage"),
        F.count_if(F.col("tmin") <= frost_threshold).alias("frost_days"),
        F.min("tmin").alias("coldest"),
        F.count_if(F.col("tmax") >= F.col("_heat")).alias("heat_days"),
        F.max("tmax").alias("hottest"),
        by_stage(F.avg, "warmth").alias("stage_temp"),
    )
    start = date_of(F.col("year"), F.col("month"), F.col("day"))
    return (
        totals.filter(F.col("_known") == F.col("season_days"))
        .drop("_known")
        .withColumn("start", start)
        .withColumn("end", F.date_add("start", F.col("season_days") - 1))
        .withColumn(
            "gross_mm", gross_irrigation(F.col("etc_mm"), F.col("rain_mm"), rain_fraction, efficiency)
        )
    )


def thermal_fit(seasons: DataFrame, tolerance: float = 1.5) -> DataFrame:
    """Largest departure of a stage temperature from the widened envelope, and the stage it happens in."""

    def departure(temp: Column, bounds: Column) -> Column:
        high, low = bounds["highest"] + tolerance, bounds["lowest"] - tolerance
        return F.when(temp > high, temp - high).when(temp < low, low - temp).otherwise(0.0)

    bounds = F.arrays_zip("lowest", "highest")
    with_departures = seasons.withColumn("_departures", F.zip_with("stage_temp", bounds, departure))
    worst = F.array_max("_departures")
    return (
        with_departures.withColumn("thermal_dev", worst)
        .withColumn("thermal_ok", worst == 0.0)
        .withColumn(
            "thermal_worst", F.when(worst > 0, (F.array_position("_departures", worst) - 1).cast("int"))
        )
        .drop("_departures")
    )


# ------------------------------------------------------------ planting dates


def planting_candidates(calibrated: DataFrame, years: DataFrame, dates: Sequence[tuple[int, int]]) -> DataFrame:
    """Every calibrated variant of a site on every planting date of every complete year."""
    plantings = F.array(*[F.struct(F.lit(m).alias("month"), F.lit(d).alias("day")) for m, d in dates])
    columns = [c for c in calibrated.columns if c != "site_id"]
    return calibrated.join(years, "site_id").select("site_id", "year", *columns, F.inline(plantings))


def evaluate(
    calibrated: DataFrame,
    weather: DataFrame,
    years: DataFrame,
    dates: Sequence[tuple[int, int]],
    fw: float,
    efficiency: float,
    cap: float | None = None,
    fixed_days: bool = False,
    tolerance: float = 1.5,
    **season_options,
) -> DataFrame:
    """One row per site, variant, planting date and year whose season is complete.

    With ``fixed_days`` the published stage lengths are used instead of the
    lengths that follow from the heat requirement.
    """
    keys = ["site_id", "crop_id", "variant"]
    limits = calibrated.select(*keys, "requirement", "lowest", "highest", "months", "frost_tolerant")
    candidates = planting_candidates(calibrated, years, dates)
    longest = _longest(calibrated) if fixed_days else MAX_SEASON_DAYS
    if not fixed_days:
        candidates = stage_lengths(candidates, weather, years, cap, longest)
    # the arrays of the calibration rejoin afterwards: day rows carry plain numbers only
    candidates = candidates.drop("requirement", "lowest", "highest", "months", "frost_tolerant")
    seasons = season_run(candidates, weather, years, fw, efficiency, longest=longest, **season_options)
    return thermal_fit(seasons.join(limits, keys), tolerance)


def sweep_dates(step: int = 15) -> list[tuple[int, int]]:
    """Planting dates (month, day) every ``step`` days of a year without a leap day."""
    import datetime

    first = datetime.date(2001, 1, 1)
    days = (first + datetime.timedelta(days=i) for i in range(0, 365, step))
    return [(d.month, d.day) for d in days]


def planting_sweep(
    seasons: DataFrame,
    max_frost_risk: float = 0.10,
    max_thermal_risk: float = 0.20,
    max_heat_days: int | None = None,
    show_all: bool = True,
) -> DataFrame:
    """Gross irrigation, season length and risk gates per site, variant and planting date.

    F marks a frost-sensitive crop with frost in too many years, T a date
    outside the thermal envelope (or too hot) in too many years; without
    ``show_all`` only unflagged dates stay.
    """
    bad = F.count_if(~F.col("thermal_ok"))
    if max_heat_days is not None:
        bad = F.greatest(bad, F.count_if(F.col("heat_days") > max_heat_days))
    table = seasons.groupBy("site_id", "crop_id", "variant", "month", "day").agg(
        F.count(F.lit(1)).alias("years"),
        F.floor(F.median("season_days")).cast("int").alias("days"),
        F.median("gross_mm").alias("gross_median"),
        F.min("gross_mm").alias("gross_min"),
        F.max("gross_mm").alias("gross_max"),
        F.count_if(F.col("frost_days") > 0).alias("frost_years"),
        bad.alias("thermal_bad"),
        F.first("frost_tolerant").alias("_tolerant"),
        F.first("months").alias("_months"),
    )
    planted = date_of(F.lit(2001), F.col("month"), F.col("day"))
    frosty = ~F.col("_tolerant") & (F.col("frost_years") / F.col("years") > max_frost_risk)
    unfit = F.col("thermal_bad") / F.col("years") > max_thermal_risk
    flags = F.concat(F.when(frosty, "F").otherwise(""), F.when(unfit, "T").otherwise(""))
    result = table.select(
        "site_id",
        "crop_id",
        "variant",
        "month",
        "day",
        "years",
        "days",
        F.date_format(F.date_add(planted, F.col("days") - 1), "dd MMM").alias("harvest"),
        "gross_median",
        "gross_min",
        "gross_max",
        "frost_years",
        "thermal_bad",
        flags.alias("flags"),
        F.array_contains("_months", F.col("month")).alias("published_month"),
    )
    return result if show_all else result.filter(F.col("flags") == "")


def planting_summary(seasons: DataFrame, areas: Sequence[float] = (15, 20)) -> DataFrame:
    """One planting date in words and figures: length, frost, thermal fit, Kc, water, volumes."""
    off = F.when(~F.col("thermal_ok"), F.col("thermal_dev"))
    worst = F.max_by(
        F.struct(
            "thermal_dev",
            "thermal_worst",
            F.get("stage_temp", "thermal_worst").alias("temp"),
            F.get("lowest", "thermal_worst").alias("low"),
            F.get("highest", "thermal_worst").alias("high"),
        ),
        F.struct(off, -F.col("year")),
    )
    water = []
    for column in ("et0_mm", "etc_mm", "rain_mm", "gross_mm"):
        water += [
            F.median(column).alias(f"{column}_median"),
            F.min(column).alias(f"{column}_min"),
            F.max(column).alias(f"{column}_max"),
        ]
    table = seasons.groupBy("site_id", "crop_id", "variant", "month", "day").agg(
        F.count(F.lit(1)).alias("years"),
        F.floor(F.median("season_days")).cast("int").alias("days_median"),
        F.min("season_days").alias("days_min"),
        F.max("season_days").alias("days_max"),
        F.count_if(F.col("frost_days") > 0).alias("frost_years"),
        F.min("coldest").alias("coldest"),
        F.count_if("thermal_ok").alias("inside_years"),
        worst.alias("_worst"),
        F.avg("kc_ini_used").alias("kc_ini"),
        F.avg("kc_mid_used").alias("kc_mid"),
        F.avg("kc_end_used").alias("kc_end"),
        *water,
        F.first("frost_tolerant").alias("_tolerant"),
    )
    names = F.array(*[F.lit(n) for n in STAGE_NAMES])
    off_any = F.col("inside_years") < F.col("years")
    planted = date_of(F.lit(2001), F.col("month"), F.col("day"))
    return (
        table.withColumn("planted", day_label(F.dayofyear(planted)))
        .withColumn("exposed", (F.col("frost_years") > 0) & ~F.col("_tolerant"))
        .withColumn("worst_departure", F.when(off_any, F.col("_worst.thermal_dev")))
        .withColumn("worst_stage", F.when(off_any, F.get(names, F.col("_worst.thermal_worst"))))
        .withColumn("worst_temp", F.when(off_any, F.col("_worst.temp")))
        .withColumn("envelope_low", F.when(off_any, F.col("_worst.low")))
        .withColumn("envelope_high", F.when(off_any, F.col("_worst.high")))
        .withColumns({f"m3_{int(a)}_dunum": volume_m3(F.col("gross_mm_median"), a) for a in areas})
        .drop("_worst", "_tolerant")
    )


def gdd_sensitivity(
    weather: DataFrame,
    years: DataFrame,
    variants: DataFrame,
    bases: Sequence[float] = SENSITIVITY_BASES,
    cap: float | None = None,
) -> DataFrame:
    """Heat requirement and the season length it gives at the published planting, for several base temperatures.

    The season starts in the middle complete year of the site; a length of 0
    means the season does not finish. A base under which all of a variant's
    years fail is absent.
    """
    runs = reference_runs(weather, years, variants, bases, cap)
    needs = gdd_requirement(runs).drop("years")
    middle = years.groupBy("site_id").agg(F.sort_array(F.collect_list("year")).alias("_years"))
    middle = middle.select(
        "site_id", F.get("_years", F.floor(F.size("_years") / 2).cast("int")).alias("year")
    )
    first_month = variants.select("crop_id", "variant", F.get("months", F.lit(0)).alias("month"), F.lit(15).alias("day"))
    candidates = needs.join(middle, "site_id").join(first_month, ["crop_id", "variant"])
    grown = stage_lengths(candidates, weather, years, cap).select(
        "site_id", "crop_id", "variant", "base", (F.col("ini") + F.col("dev") + F.col("mid") + F.col("late")).alias("_days")
    )
    heat = F.aggregate("requirement", F.lit(0.0), lambda a, v: a + v)
    return needs.join(grown, ["site_id", "crop_id", "variant", "base"], "left").select(
        "site_id",
        "crop_id",
        "variant",
        "base",
        heat.alias("gdd_total"),
        F.coalesce("_days", F.lit(0)).alias("season_days"),
    )
