"""Queries over stores that are filled in several loads, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketclime.operators import quality
from marketclime.session import scratch_path
from marketclime.sources.prices import with_month
from marketclime.sources.store import LoadStore
from marketclime.streaming import ingest as streams
from marketclime.streaming import state
from standin import views
from standin.oracles import ORACLES
from standin.queries import query, tidy
from standin.source_oracles import EVENTS, SERVED
from standin.views import CLEAN_SQL, OBS_SQL

SECOND = 20000  # rows before this place of the file come in the second load


@query
def load_log_clean(spark, sf_dir):
    """The store filled in two loads, the file's later rows first, then cleaned as a whole."""
    rows = with_month(views.observations(spark, sf_dir).withColumnRenamed("ordinal", "line"))
    store = LoadStore(spark, scratch_path(spark, "loads"))
    store.append(rows.filter(F.col("line") >= SECOND), "files", 0, ["line"])
    store.append(rows.filter(F.col("line") < SECOND), "files", 1, ["line"])
    cleaned = quality.clean_prices(store.read().drop("month", "load", "line"))
    return tidy(cleaned.select("date", "item", "ordinal", "price_mode", "duplicate", "outlier", "usable"))


_LOADS = """
obs as (select * exclude (ordinal, load), load * 1099511627776 + row_number() over (partition by load order by ordinal) - 1 as ordinal
  from (select *, case when ordinal >= 20000 then 0 else 1 end as load from obs_file))"""
# without a row in the first load, the second part of the file is the first load
_CLEAN = CLEAN_SQL.replace(OBS_SQL, OBS_SQL.replace("\nobs as (", "\nobs_file as (") + "," + _LOADS)
assert _CLEAN.count("obs as (") == 1
ORACLES["load_log_clean"] = f"""with {_CLEAN}
select date, item, ordinal, round(price_mode, 4) as price_mode, duplicate, outlier, usable from clean"""


@query
def stream_page_loads(spark, sf_dir):
    """Pages of two days of fetching, parsed in the pass that stores them: two loads, positions by page and row."""
    folder, root, progress = (scratch_path(spark, x) for x in ("pages", "page-loads", "progress"))
    pages = views.pages(spark, sf_dir)
    even = F.dayofyear("expected") % 2 == 0
    for part in (even, ~even):
        pages.filter(part).write.mode("append").parquet(folder)
        arriving = spark.readStream.schema("path string, html string, expected date").parquet(folder)
        streams.ingest_page_loads(arriving, root, progress)
    back = LoadStore(spark, root).read()
    return back.select("date", "item", "unit", "price_low", "price_mode", "quantity", "load", "ordinal")


ORACLES["stream_page_loads"] = f"""with {OBS_SQL},{SERVED},
placed as (
  select *, (dayofyear(date) % 2)::bigint as load, 'raw/' || block || '/' || date || '.html' as path from served)
select date, item, unit, price_low, price_mode, quantity, load,
  load * 1099511627776 + row_number() over (partition by load order by path, ordinal) - 1 as ordinal
from placed"""


@query
def stream_weather_loads(spark, sf_dir):
    """Weather of two loads by year: settled rows win, then the later load, then the later place."""
    folder, root, progress = (scratch_path(spark, x) for x in ("weather-rows", "weather-loads", "progress"))
    events = views.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("site_id"),
        F.col("ts").cast("date").alias("date"),
        F.col("value").alias("tmax"),
        F.when(F.col("event_type") == "purchase", "era5_archive").otherwise("preliminary").alias("source"),
        F.col("event_id").alias("line"),
    )
    first = F.col("line") % 2 == 1
    for part in (first, ~first):
        events.filter(part).write.mode("append").parquet(folder)
        arriving = spark.readStream.schema(events.schema).parquet(folder)
        streams.ingest_weather_loads(arriving, root, progress, ["line"])
    return LoadStore(spark, root, "year").read().select("site_id", "date", "tmax", "source", "load")


ORACLES["stream_weather_loads"] = (
    EVENTS
    + """
select user_id as site_id, date, value as tmax, case event_type when 'purchase' then 'era5_archive' else 'preliminary' end as source,
  (1 - ordinal % 2)::bigint as load
from e qualify row_number() over (partition by user_id, date
  order by event_type = 'purchase' desc, ordinal % 2, ordinal desc) = 1"""
)


def _dripped(spark, frame, folder, batch):
    """A stream of ``frame`` in micro-batches, by the number column ``batch``."""
    for n in sorted(r[0] for r in frame.select(batch).distinct().collect()):
        # one file per batch; a repartition, so that the rows are read and filtered in many tasks
        frame.filter(F.col(batch) == n).drop(batch).repartition(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(frame.drop(batch).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def event_days(spark, sf_dir):
    events = views.table(spark, sf_dir, "events")
    return events.withColumn("date", F.col("ts").cast("date"))


@query
def stream_weekly_medians(spark, sf_dir):
    """Exact medians kept by state over four batches; each tenth row comes a batch late."""
    folder, root, progress = (scratch_path(spark, x) for x in ("arriving", "medians", "progress"))
    days = event_days(spark, sf_dir)
    first = days.agg(F.min("date")).scalar()
    value = F.col("value")
    rows = days.select(
        "date",
        F.concat(F.lit("user "), (F.col("user_id") % 40).cast("string")).alias("item"),
        value.alias("price_mode"),
        F.when(F.col("event_id") % 4 != 0, value * 0.5).alias("price_low"),
        (value * 1.5).alias("price_high"),
        (F.col("event_id") % 5).cast("double").alias("quantity"),
        (F.floor(F.date_diff("date", first) / 10) + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0)).cast("int").alias("batch"),
    )

    state.publish_medians(state.weekly_medians(_dripped(spark, rows, folder, "batch")), root, progress)
    return tidy(LoadStore(spark, root).read().select("item", "week_start", "mode", "low", "high", "qty_t", "n"))


ORACLES["stream_weekly_medians"] = """with e as (
  select 'user ' || (user_id % 40) as item, cast(ts as date) as date, value, event_id from events),
w as (
  select *, date '1970-01-01' + cast(floor((date - date '1970-01-01' + 5) / 7.0)*7 - 5 as int) as week_start,
    event_id % 4 <> 0 as pair from e where value is not null)
select item, week_start, round(median(value), 4) as mode, round(median(value * 0.5) filter (where pair), 4) as low,
  round(median(value * 1.5) filter (where pair), 4) as high,
  round(median((event_id % 5)::double) filter (where event_id % 5 <> 0), 4) as qty_t, count(*) as n
from w group by 1, 2"""


@query
def stream_missing_days(spark, sf_dir):
    """Days without a row per event type, by timers; some days come four days late and are taken back."""
    folder, root, progress = (scratch_path(spark, x) for x in ("arriving", "missing", "progress"))
    day = F.dayofyear("date")
    late = day % 5 == 0
    rows = event_days(spark, sf_dir).filter((day + F.length("event_type")) % 7 != 0)
    rows = rows.select(
        F.col("event_type").alias("market"),
        "date",
        (F.col("ts").cast("timestamp") + F.when(late, F.expr("interval 4 days")).otherwise(F.expr("interval 0 days"))).alias("fetched"),
    )
    first = rows.agg(F.min("date")).head()[0]
    if first is None:
        return spark.createDataFrame([], "market string, date date")
    rows = rows.withColumn("batch", F.floor(F.date_diff(F.col("fetched").cast("date"), F.lit(first)) / 8).cast("int"))

    state.publish_missing_days(state.missing_day_events(_dripped(spark, rows, folder, "batch"), first), root, progress)
    return state.still_missing(root, spark)


ORACLES["stream_missing_days"] = """with r as (
  select event_type as market, cast(ts as date) as date,
    ts + case when dayofyear(cast(ts as date)) % 5 = 0 then interval 4 day else interval 0 day end as fetched
  from events where (dayofyear(cast(ts as date)) + length(event_type)) % 7 <> 0),
span as (select min(date) as first, max(fetched) - interval 1 day as seen from r),
days as (
  select market, (first + i)::date as date, seen from (select distinct market from r), span,
    (select unnest(range(0, 400))::int as i) where first + i < seen)
select market, date from days anti join r using (market, date)
where isodow(date) <> 5 and date::timestamp + interval 2 day < seen"""
