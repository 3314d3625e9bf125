"""SQL for the page, payload, parameter, output and stream queries."""

from __future__ import annotations

from standin.oracles import ORACLES, cleaned, obs
from standin.views import WEATHER_SQL

SHOWN = """
shown as (select *, ordinal // 20000 as block,
  date + (case when unit = 'box' and ordinal % 7 = 0 then 1 else 0 end) as shown from obs)"""
SERVED = (
    SHOWN
    + """,
served as (select s.* from shown s
  join (select date, block from shown group by 1, 2 having count(*) filter (where shown <> date) = 0)
  using (date, block))"""
)
obs(
    "page_rows",
    """select shown as date, item, unit, price_low, price_mode, price_high, quantity, order_ok,
  cast(date as varchar) || '.html' as source_file from shown""",
    SHOWN,
)
ORACLES["headed_page_rows"] = ORACLES["page_rows"]
obs(
    "page_parsers",
    """select count(*) filter (where false) as empty, count(*) filter (where block % 3 <> 0) as native,
  count(*) filter (where block % 3 = 0) as parsed from (select distinct date, block from shown)""",
    SHOWN,
)
obs("requested_page_rows", "select date, item, unit, price_low, price_mode, quantity from served", SERVED)
obs(
    "page_counts",
    "select 'raw/' || block || '/' || date || '.html' as path, cast(count(*) as int) as row_count from shown group by date, block",
    SHOWN,
)
ORACLES["bare_pages"] = "select 0 as row_count, count(*) as pages from pages"
ORACLES["columnar_to_rows"] = """select vec_id, date '2020-01-01' + i as date, round(embedding[i+1]::double, 6) as temperature_2m_max,
  case when i < 10 then round(embedding[i+1]::double, 6) end as precipitation_sum, null::double as rain_sum
from (select vec_id, embedding, unnest(range(0, len(embedding)))::int as i from embeddings)"""
ORACLES["crop_listing"] = """select 'c' || p_partkey as id, p_name as name_en, p_size % 3 as variants,
  case when p_type = 'PROMO' then 'tolerant' else 'sensitive' end as frost,
  case when p_size % 5 <> 0 and p_size % 3 > 0 then 'ready'
       else 'INCOMPLETE: ' || 'no figures published for ' || p_name || ' ' || p_brand || ' ' || p_type end as status
from part"""
ORACLES["crop_variants"] = """select 'c' || p_partkey as crop_id, v as variant, p_size + v as ini, p_size + 10 as dev, p_size + 20 as mid,
  15 + v as late, ['10', '5,6', '10,11', '4,12', '3'][(p_size + v) % 5 + 1] as months, 0.5e0 as kc_ini,
  round(p_size / 40, 4) as kc_mid, round(p_size / 50, 4) as kc_end, round(p_size / 10, 4) as height,
  p_type = 'PROMO' as frost_tolerant, case when p_size % 2 = 0 then 34.0e0 end as heat_threshold
from part cross join (select unnest([0, 1]) as v) where p_size % 5 <> 0 and v < p_size % 3"""
ORACLES["cell_values"] = """select row_number() over () - 1 as ordinal, l_extendedprice as number,
  case when l_linenumber % 4 <> 3 then cast(l_shipdate as date) end as day from lineitem"""
ORACLES["calendar_keys"] = """with d as (select distinct cast(l_shipdate as date) as date from lineitem),
w as (select date, cast(floor((date - date '1970-01-01' + 5) / 7.0) as int) as week from d),
s as (select *, date '1970-01-01' + cast(week*7 - 5 as int) as week_start from w)
select date, week, week_start, least(52, (dayofyear(week_start) - 1) // 7) as week_of_year,
  case when month(date) >= 10 then year(date) else year(date) - 1 end as hydro_year,
  strftime(date, '%Y-%m') as month, strftime(date '2001-01-01' + cast(dayofyear(date) - 1 as int), '%d %b') as label,
  isodow(date) <> 5 as open from s"""
ORACLES["agronomy_terms"] = f"""with {WEATHER_SQL},
t as (select *, (dayofyear(date) % 150) as i, wind_max/3.6*4.87/ln(67.8*10-5.42) as u2v,
   100.0*(0.6108*exp(17.27*(tmin-2.0)/(tmin-2.0+237.3)))/(0.6108*exp(17.27*tmax/(tmax+237.3))) as rhv from weather)
select site_id, date, round(0.6108*exp(17.27*tmax/(tmax+237.3)), 6) as svp, round(u2v, 6) as u2, round(rhv, 6) as rh,
  round(1.05 + (0.04*(greatest(1.0, least(6.0, u2v)) - 2.0) - 0.004*(greatest(20.0, least(80.0, rhv)) - 45.0))
        * power(0.7e0/3.0, 0.3e0), 6) as kc_mid,
  round(case when i <= 25 then 0.24e0 when i <= 60 then 0.24e0 + (i-25)/35*(1.05e0-0.24e0) when i <= 120 then 1.05e0
        else 1.05e0 + (i-120)/30*(0.9e0-1.05e0) end, 6) as kc,
  round(greatest(0, (least(tmax, 30.0) + least(tmin, 30.0))/2 - 8.0), 6) as gdd,
  round(greatest(0.0, et0 - 0.5*precip)/0.9, 6) as gross
from t"""
obs(
    "month_store",
    """select date, item, ordinal, price_mode, strftime(date, '%Y-%m') as month from obs
where strftime(date, '%Y-%m') in ('1996-02', '1999-11')
qualify row_number() over (partition by date, item order by ordinal) = 1""",
)
cleaned(
    "series_payload",
    """select printf('s%03d', number) as series_id, item as name, weeks, seasons, first_week,
  (select count(*) from us where us.item = x.item and us.week_start = x.first_week) as first_n
from (select item, count(distinct week) as weeks, min(week_start) as first_week, count(distinct date) as days,
        row_number() over (order by count(*) desc, min(ordinal)) - 1 as number from us group by item) x
join (select item, count(*) as seasons from
        (select item, week_of_year from us group by 1, 2 having count(*) >= 4) group by item) using (item)
where days >= 150""",
)
EVENTS = """with e as (select event_id as ordinal, ts, cast(ts as date) as date, 'user ' || user_id as item, user_id,
  event_type, value from events)"""
ORACLES["stream_weekly_counts"] = (
    EVENTS
    + """
select date '1970-01-01' + cast(floor((date - date '1970-01-01' + 5) / 7.0)*7 - 5 as int) as week_start, event_type,
  count(*) as n, round(sum(value), 4) as total, min(value) as lowest, max(value) as highest from e group by 1, 2"""
)
ORACLES["stream_dedup_ingest"] = (
    EVENTS
    + """
select date, item, ordinal, value as price_mode from e
qualify row_number() over (partition by date, item order by ordinal) = 1"""
)
ORACLES["stream_recent_keys"] = EVENTS + "\nselect distinct date, item from e"
ORACLES["stream_weather_merge"] = (
    EVENTS
    + """
select user_id as site_id, date, value as tmax,
  case event_type when 'purchase' then 'era5_archive' else 'preliminary' end as source
from e qualify row_number() over (partition by user_id, date order by event_type = 'purchase' desc, ordinal desc) = 1"""
)
obs("stream_page_ingest", "select date, item, unit, price_low, price_mode, quantity from served", SERVED)
