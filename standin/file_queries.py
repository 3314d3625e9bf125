"""Queries over documents and month files that are written and read back, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketclime.operators import quality
from marketclime.session import cut_lineage, scratch_path
from marketclime.sources import documents, files, sinks
import standin.water_oracles  # noqa: F401  (its SQL is used here)
from standin import views
from standin.oracles import ORACLES, cleaned
from standin.queries import clean, query, tags, tidy
from standin.views import OBS_SQL


def written(spark, table, key, name):
    """The rows of ``table`` after a way through JSON files."""
    folder = scratch_path(spark, name)
    table = cut_lineage(table, name)
    files.write_documents(documents.documents(table, key), folder)
    return documents.parsed(files.read_documents(spark, folder), table)


@query
def series_documents(spark, sf_dir):
    """Every weekly and seasonal cell of the documents, one file per series."""
    cleaned_rows = cut_lineage(clean(spark, sf_dir), "clean")
    table = documents.series_table(cleaned_rows, tags(spark, sf_dir), digits=None)
    back = written(spark, table, "series_id", "series")
    entry = back.select("series_id", "name", "crop", "days", "first", "last", "weekly", "seasonal")
    weekly = entry.select("*", F.explode("weekly").alias("w")).select(
        "series_id", "name", "crop", "days", "first", "last", F.lit("weekly").alias("part"), F.col("w.week").alias("place"), "w.n",
        F.col("w.mode").alias("a"), F.col("w.low").alias("b"), F.col("w.high").alias("c"), F.lit(None).cast("double").alias("d"),
        F.lit(None).cast("double").alias("e"), "w.qty_t",
    )
    seasonal = entry.select("*", F.explode("seasonal").alias("s")).select(
        "series_id", "name", "crop", "days", "first", "last", F.lit("seasonal").alias("part"), F.col("s.week_of_year").alias("place"), "s.n",
        F.col("s.p10").alias("a"), F.col("s.p25").alias("b"), F.col("s.median").alias("c"), F.col("s.p75").alias("d"),
        F.col("s.p90").alias("e"), "s.qty_t",
    )
    return tidy(weekly.unionByName(seasonal), 6)


_SERIES = """, entry as (
  select printf('s%03d', number) as series_id, s.item as name, crop_id as crop, days, "first", "last"
  from (select item, count(distinct date) as days, min(date) as "first", max(date) as "last",
          row_number() over (order by count(*) desc, min(ordinal)) - 1 as number
        from us group by item) s left join crops_of using (item)
  where days >= 150),
wk as (
  select item, 'weekly' as part, week as place, count(*) as n, median(price_mode) as a, median(price_low) as b,
    median(price_high) as c, null::double as d, null::double as e, median(quantity) as q from us group by item, week),
sn as (
  select item, 'seasonal' as part, week_of_year as place, count(*) as n, quantile_cont(price_mode, 0.10) as a,
    quantile_cont(price_mode, 0.25) as b, quantile_cont(price_mode, 0.50) as c, quantile_cont(price_mode, 0.75) as d,
    quantile_cont(price_mode, 0.90) as e, median(quantity) as q
  from us group by item, week_of_year having count(*) >= 4)"""
cleaned(
    "series_documents",
    """select series_id, name, crop, days, "first", "last", part, place, n, round(a, 6) as a, round(b, 6) as b, round(c, 6) as c,
  round(d, 6) as d, round(e, 6) as e, round(q, 6) as qty_t
from entry join (from wk union all from sn) on item = name""",
    _SERIES.lstrip(","),
)


@query
def latest_document(spark, sf_dir):
    """The two days and every item of the latest bulletin, in the document's order."""
    table = documents.latest_table(clean(spark, sf_dir), tags(spark, sf_dir), digits=None)
    back = written(spark, table, F.lit("latest"), "latest")
    rows = back.select("date", "previous", F.posexplode("items").alias("place", "i"))
    return tidy(rows.select("date", "previous", "place", "i.*"))


_LATEST = ORACLES["latest_snapshot"]
_HEAD, _TAIL = _LATEST.rsplit("\nselect t.item", 1)
ORACLES["latest_document"] = f"""{_HEAD},
listed as (select item, min(ordinal) as first_listed from us group by item),
shown as (select t.item{_TAIL})
select latest as date, previous, cast(row_number() over (order by -coalesce(t.quantity_listed, 0), first_listed) - 1 as int) as place, shown.*
from shown join t using (item) join listed using (item), d"""


@query
def weather_documents(spark, sf_dir):
    """Days, months, rain seasons and complete years of the documents, one file per site."""
    table = documents.weather_table(views.weather(spark, sf_dir), digits=None)
    back = written(spark, table, "site_id", "weather")
    none = F.lit(None).cast("double")

    def part(name, column, place, *values):
        cells = [(F.col(f"x.{v}").cast("double") if v else none).alias(c) for c, v in zip("abcde", values)]
        return back.select("site_id", "first", "last", F.explode(column).alias("x")).select(
            "site_id", "first", "last", F.lit(name).alias("part"), F.col(place).cast("int").alias("place"), *cells
        )

    every = part("day", "daily", "x.epoch_day", "tmax", "tmin", "rain_mm", "et0_mm", "settled")
    every = every.unionByName(part("month", "monthly", "x.month", "tmax", "tmin", "rain", "et0", "frost_nights"))
    every = every.unionByName(part("season", "seasonal_rain", "x.season", "rain_mm", None, None, None, None))
    return tidy(every.unionByName(part("year", "complete_years", "x", None, None, None, None, None)))


@query
def climate_documents(spark, sf_dir):
    """Complete years, heat sums and rain seasons of the climate documents."""
    table = documents.climate_table(views.weather(spark, sf_dir), (0.0, 2.0, 8.0), (3, 15), 10.0)
    back = written(spark, table, "site_id", "climate")
    none = F.lit(None).cast("double")
    years = back.select("site_id", F.lit("year").alias("part"), F.explode(F.col("complete_years").cast("array<double>")).alias("place"), none.alias("a"), none.alias("b"), none.alias("c"))
    sums = back.select("site_id", F.explode("gdd.days_to_target").alias("x")).select(
        "site_id", F.lit("gdd").alias("part"), F.col("x.target").alias("place"), F.col("x.median_days").alias("a"),
        F.col("x.fastest").cast("double").alias("b"), F.col("x.slowest").cast("double").alias("c"),
    )
    rain = back.select("site_id", F.explode("seasonal_rainfall_mm").alias("x")).select(
        "site_id", F.lit("season").alias("part"), F.col("x.season").cast("double").alias("place"), F.col("x.rain_mm").alias("a"), none.alias("b"), none.alias("c")
    )
    frost = back.select("site_id", F.explode("frost").alias("x")).select(
        "site_id", F.lit("frost").alias("part"), F.col("x.threshold").alias("place"), F.col("x.spring_p90").alias("a"),
        F.col("x.autumn_p10").alias("b"), F.col("x.frost_free_median").alias("c"),
    )
    return tidy(years.unionByName(sums).unionByName(rain).unionByName(frost))


_D = ORACLES
_WEATHER = """
select site_id, "first", "last", 'day' as part, cast(epoch_day as int) as place, tmax as a, tmin as b, rain_mm as c, et0_mm as d, settled::double as e
from ({daily}) join span using (site_id)
union all select site_id, "first", "last", 'month', month::int, tmax, tmin, rain, et0, frost_nights from ({monthly}) join span using (site_id)
union all select site_id, "first", "last", 'season', season::int, rain_mm, null, null, null, null from ({hydro}) join span using (site_id)
union all select site_id, "first", "last", 'year', year::int, null, null, null, null, null from ({years}) join span using (site_id)"""
ORACLES["weather_documents"] = (
    f'with {views.WEATHER_SQL}, span as (select site_id, min(date) as "first", max(date) as "last" from weather group by 1)'
    + _WEATHER.format(daily=_D["daily_payload"], monthly=_D["monthly_climatology"], hydro=_D["hydro_rain"], years=_D["complete_years"])
)
ORACLES["climate_documents"] = f"""
select site_id, 'year' as part, year::double as place, null::double as a, null::double as b, null::double as c from ({_D["complete_years"]})
union all select site_id, 'gdd', target, median_days, fastest::double, slowest::double from ({_D["gdd_days_to_target"]})
union all select site_id, 'season', season::double, rain_mm, null, null from ({_D["hydro_rain"]})
union all select site_id, 'frost', threshold, spring_p90, autumn_p10, frost_free_median from ({_D["frost_summary"]})"""


@query
def month_files(spark, sf_dir):
    """Two years of gzip months, read back with a filter on the month."""
    path = scratch_path(spark, "month-files")
    sinks.write_month_files(quality.first_row_distinct(views.observations(spark, sf_dir)), path)
    back = files.read_months(spark, path).filter(F.col("month").between("1996-02", "1998-01"))
    return back.select("date", "item", "unit", "price_low", "price_mode", "price_high", "quantity", "order_ok", "month")


ORACLES["month_files"] = f"""with {OBS_SQL}
select date, item, unit, price_low, price_mode, price_high, quantity, order_ok, strftime(date, '%Y-%m') as month from obs
where strftime(date, '%Y-%m') between '1996-02' and '1998-01'
qualify row_number() over (partition by date, item order by ordinal) = 1"""
