"""SQL for the climate, ingest, water demand and yield queries.

Heat sums are integers in 1/200 degree here (the stand-in weather is given in
hundredths) and a mean need is compared as a sum over its years, so the day a
stage ends is exact.
"""

from __future__ import annotations

from standin.oracles import ORACLES, obs
from standin.views import CROP_SQL, WEATHER_SQL

SETTLED = """days as (select *, year(date) as year, month(date) as month, dayofyear(date) as doy
  from weather where source = 'era5_archive'),
cy as (select site_id, year from days group by 1, 2 having count(*) >= 360),
ny as (select site_id, count(*) as years from cy group by 1),
usable as (select d.* from days d semi join cy using (site_id, year)),
months as (select site_id, years, unnest(range(1, 13)) as month from ny)"""


def climate(name: str, sql: str, ctes: str = "") -> None:
    ORACLES[name] = f"with {WEATHER_SQL},\n{SETTLED}{',' + ctes if ctes else ''}\n{sql}"


climate(
    "complete_years",
    "select site_id, year, count(*) as days from days where tmax is not null group by 1, 2 having count(*) >= 360",
)
climate(
    "monthly_climatology",
    """select m.site_id, m.month, round(avg(tmax), 4) as tmax, round(avg(tmin), 4) as tmin,
  round(sum(precip) / any_value(years), 4) as rain, round(sum(et0) / any_value(years), 4) as et0,
  round(count(*) filter (where tmin <= 0) / any_value(years), 4) as frost_nights
from months m left join usable u on u.site_id = m.site_id and u.month = m.month group by 1, 2""",
)
climate(
    "monthly_climatology_totals",
    """select site_id, month,
  ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][month] as label,
  round(any_value(tmax), 4) as tmax_mean_c, round(any_value(tmin), 4) as tmin_mean_c,
  round(avg(coalesce(rain, 0)), 4) as rain_mean_mm, round(avg(coalesce(et0, 0)), 4) as et0_mean_mm
from (select c.site_id, m.month, c.year, t.tmax, t.tmin, p.rain, p.et0
      from cy c cross join (select unnest(range(1, 13)) as month) m
      left join (select site_id, month, avg(tmax) as tmax, avg(tmin) as tmin from usable group by 1, 2) t
        on t.site_id = c.site_id and t.month = m.month
      left join (select site_id, year, month, sum(precip) as rain, sum(et0) as et0 from usable group by 1, 2, 3) p
        on p.site_id = c.site_id and p.year = c.year and p.month = m.month)
group by 1, 2""",
)
climate(
    "heat_days",
    """select m.site_id, m.month, threshold,
  round((select count(*) from usable u where u.site_id = m.site_id and u.month = m.month and u.tmax >= threshold)
        / years, 4) as days_per_year
from months m cross join (select unnest([30.0e0, 33.0e0, 35.0e0]) as threshold)""",
)
HYDRO = """
hydro as (select site_id, case when month >= 10 then year else year - 1 end as season, sum(precip) as rain_mm,
            count(*) as days from days where precip is not null group by 1, 2 having count(*) >= 360)"""
climate("hydro_rain", "select site_id, season, round(rain_mm, 4) as rain_mm, days from hydro", HYDRO)
climate(
    "hydro_rain_distribution",
    """select site_id, count(*) as seasons, min(rain_mm) as driest, round(quantile_cont(rain_mm, 0.25), 4) as p25,
  round(quantile_cont(rain_mm, 0.5), 4) as median, round(quantile_cont(rain_mm, 0.75), 4) as p75,
  max(rain_mm) as wettest from hydro group by 1""",
    HYDRO,
)
climate(
    "extreme_seasons",
    """select site_id, season, rain_mm, place, 'driest' as "end" from r where place <= 2
union all select site_id, season, rain_mm, place, 'wettest' from r where place > n - 2""",
    HYDRO
    + """, r as (select site_id, season, rain_mm,
    row_number() over (partition by site_id order by rain_mm, season) as place,
    count(*) over (partition by site_id) as n from hydro)""",
)
FROST = """
thr as (select unnest([0.0e0, 2.0e0, 8.0e0]) as threshold),
fd as (select site_id, year, threshold, max(doy) filter (where month <= 6) as last_spring_doy,
         min(doy) filter (where month >= 7) as first_autumn_doy
       from usable cross join thr where tmin <= threshold group by 1, 2, 3)"""
climate("frost_dates", "select * from fd", FROST)
climate(
    "frost_summary",
    """select n.site_id, t.threshold, any_value(years) as complete_years,
  round(quantile_cont(last_spring_doy, 0.5), 4) as spring_p50,
  round(quantile_cont(last_spring_doy, 0.9), 4) as spring_p90,
  max(last_spring_doy) as spring_max,
  round(quantile_cont(first_autumn_doy, 0.5), 4) as autumn_p50,
  round(quantile_cont(first_autumn_doy, 0.1), 4) as autumn_p10,
  min(first_autumn_doy) as autumn_min,
  count(last_spring_doy) as spring_years, count(first_autumn_doy) as autumn_years,
  median(first_autumn_doy - last_spring_doy) as frost_free_median,
  min(first_autumn_doy - last_spring_doy) as frost_free_min,
  max(first_autumn_doy - last_spring_doy) as frost_free_max,
  strftime(date '2001-01-01' + cast(round_even(quantile_cont(last_spring_doy, 0.9), 0) as int) - 1, '%d %b')
    as spring_p90_label,
  strftime(date '2001-01-01' + cast(round_even(quantile_cont(first_autumn_doy, 0.1), 0) as int) - 1, '%d %b')
    as autumn_p10_label
from ny n cross join thr t left join fd on fd.site_id = n.site_id and fd.threshold = t.threshold
group by 1, 2""",
    FROST,
)
climate(
    "gdd_days_to_target",
    """select site_id, target, median(days) as median_days, min(days) as fastest, max(days) as slowest, count(*) as years
from (select site_id, start_year, target, min(k) filter (where total >= 200 * target) as days
      from s cross join (select unnest([400e0, 800e0, 1200e0, 1600e0, 2000e0]) as target) group by 1, 2, 3)
where days is not null group by 1, 2""",
    """
s as (select c.site_id, c.year as start_year, u.date - make_date(c.year, 3, 15) + 1 as k,
        sum(greatest(0, round(u.tmax*100) + round(u.tmin*100) - 2000)) over (
          partition by c.site_id, c.year order by u.date) as total
      from cy c join usable u on u.site_id = c.site_id
        and u.date >= make_date(c.year, 3, 15) and u.date < make_date(c.year, 3, 15) + 365)""",
)
climate(
    "daily_payload",
    """select site_id, date - date '1970-01-01' as epoch_day, round(tmax, 4) as tmax, round(tmin, 4) as tmin,
  precip as rain_mm, round(et0, 4) as et0_mm, cast(source = 'era5_archive' as int) as settled from weather""",
)
climate(
    "weather_checks",
    """select site_id, round(min(tmin), 4) as min_tmin, count(*) filter (where tmin <= 0) as frost_days,
  count(distinct year) as years, round(count(*) filter (where tmin <= 0) / count(distinct year), 4) as frost_days_per_year,
  any_value(a) as rain_min, any_value(b) as rain_median, any_value(c) as rain_max
from days left join (
  select site_id, min(rain) as a, list_sort(list(rain))[count(*) // 2 + 1] as b, max(rain) as c
  from (select site_id, year, sum(precip) as rain from days group by 1, 2)
  where year <> (select min(year(date)) from weather w where w.site_id = site_id) group by 1) using (site_id)
group by 1""",
)
ORACLES["weather_checks"] = ORACLES["weather_checks"].replace(
    "from (select site_id, year, sum(precip) as rain from days group by 1, 2)\n  where year <> (select min(year(date)) "
    "from weather w where w.site_id = site_id) group by 1)",
    "from (select site_id, year, sum(precip) as rain from days group by 1, 2) r\n  where year <> (select min(year(date)) "
    "from weather w where w.site_id = r.site_id) group by 1)",
)
climate(
    "ingest_metadata",
    """select site_id, count(*) as row_count, count(*) filter (where source = 'era5_archive') as settled,
  count(*) filter (where source <> 'era5_archive') as preliminary,
  max(date) filter (where source = 'era5_archive') as archive_last_date, min(date) as "first", max(date) as "last"
from weather group by 1""",
)
climate(
    "weather_merge",
    """select site_id, date, round(tmax, 4) as tmax, round(tmin, 4) as tmin, precip, source
from (select site_id, date, tmax, tmin, precip, 'era5_archive' as source, 1 as p, 0 as ordinal
      from weather where day(date) <> 7
      union all
      select 0, cast(o_orderdate as date), o_totalprice % 40, o_totalprice % 10, null, 'preliminary', 0,
        row_number() over () from orders)
qualify row_number() over (partition by site_id, date order by p desc, ordinal desc) = 1""",
)

NO_BULLETIN = """
nb as (select distinct cast(o_orderdate as date) as date from orders
       where strftime(o_orderdate, '%m-%d') in ('03-01', '05-13'))"""
obs(
    "missing_days",
    """select date from (select unnest(generate_series(lo, hi, interval 1 day))::date as date
  from (select min(date) as lo, max(date) as hi from have))
where isodow(date) <> 5 and date not in (select date from have) and date not in (select date from nb)""",
    NO_BULLETIN + ", have as (select date from obs where day(date) <> 13)",
)
obs(
    "wanted_days",
    """select date from (select unnest(generate_series(today - 60, today - 1, interval 1 day))::date as date
  from (select max(date) + 3 as today from have))
where isodow(date) <> 5 and date not in (select date from have) and date not in (select date from nb)
order by date desc limit 10""",
    NO_BULLETIN + ", have as (select date from obs where day(date) % 4 <> 1)",
)
CHECKPOINT = """with ck as (
  select cast(o_orderdate as date) as day,
    max(case o_orderstatus when 'F' then 'ok' when 'O' then 'empty' else 'empty_confirmed' end) as status
  from orders group by 1)"""
ORACLES["unfetched_days"] = (
    CHECKPOINT
    + """
select date from (select unnest(generate_series(min(o_orderdate)::date, max(o_orderdate)::date, interval 1 day))::date
  as date from orders)
where isodow(date) <> 5 and date not in (select day from ck where status in ('ok', 'empty_confirmed'))"""
)
ORACLES["checkpoint_statuses"] = (
    CHECKPOINT
    + """
select case status when 'empty' then 'empty_unverified' else status end as status, count(*) as days from ck group by 1"""
)
obs(
    "upsert_new_rows",
    """select date, item, ordinal, price_mode from obs where ordinal % 3 <> 0
union all
select date, item, ordinal, price_mode from (
  select * from obs o where ordinal % 3 = 0
    and not exists (select 1 from obs s where s.ordinal % 3 <> 0 and s.date = o.date and s.item = o.item)
  qualify row_number() over (partition by date, item order by ordinal) = 1)""",
)
obs(
    "observation_state",
    """select min(date) as "first", max(date) as "last", count(distinct date) as days_with_data,
  (select string_agg(cast(date as varchar), ',' order by date) from nb) as absent from obs""",
    NO_BULLETIN,
)

# ---------------------------------------------------------------- water demand

GDD = "greatest(0, (least(tmax, 30.0) + least(tmin, 30.0))/2 - {base})"
STAGE = "case when k <= ini then 0 when k <= ini+dev then 1 when k <= ini+dev+mid then 2 else 3 end"


def runs_sql(bases: str) -> str:
    gdd = GDD.format(base="base")
    sums = ", ".join(f"sum({gdd}) filter (where stage = {i}) as gdd{i}" for i in range(4))
    temps = ", ".join(f"avg((tmax+tmin)/2) filter (where stage = {i}) as temp{i}" for i in range(4))
    return f"""
cy as (select site_id, year(date) as year from weather where source = 'era5_archive' and et0 is not null
       group by 1, 2 having count(*) >= 360),
rc as (select site_id, year, crop_id, variant, ini, dev, mid, late, months, unnest(range(1, len(months)+1)) as r
       from cy cross join crops),
rs as (select *, months[r] as month, make_date(year, months[r], 15) as start, ini+dev+mid+late as total from rc),
rd as (select *, {STAGE} as stage from (
       select rs.*, w.tmin, w.tmax, w.date - start + 1 as k
       from rs join weather w on w.site_id = rs.site_id and w.date >= start and w.date < start + total)),
runs as (select site_id, year, crop_id, variant, r-1 as month_rank, month, base, {sums}, {temps}
       from rd cross join (select unnest([{bases}]) as base)
       group by all having count(*) = any_value(total)),
need as (select site_id, crop_id, variant, base, count(*) as years,
         {", ".join(f"avg(gdd{i}) as need{i}, sum(round(200*gdd{i})) as heat{i}" for i in range(4))}
       from runs where month_rank = 0 group by all),
env as (select n.site_id, n.crop_id, n.variant, n.base,
         {", ".join(f"min(temp{i}) as low{i}, max(temp{i}) as high{i}" for i in range(4))}
       from need n join runs r on r.site_id = n.site_id and r.crop_id = n.crop_id and r.base = n.base
         and (r.variant <> n.variant or r.month_rank = 0)
       group by all)"""


RUNS = runs_sql("8.0e0")


def grown_sql(candidates: str) -> str:
    """Stage ends by chained lookups in a running integer heat sum; needs ``candidates`` as cand0."""
    steps, last = [], "st"
    for i in range(4):
        after = "x.start" if i == 0 else f"x.e{i - 1} + 1"
        have = "x.p0" if i == 0 else f"x.q{i - 1}"
        steps.append(
            f"""g{i} as (select x.*, l.e as e{i}, l.q as q{i} from {last} x, lateral (
         select min(date) as e, min(h) as q from pw where pw.site_id = x.site_id and pw.base = x.base
           and date >= {after} and date < x.start + 400 and (h - {have}) * x.years >= x.heat{i}) l)"""
        )
        last = f"g{i}"
    return f"""
pw as (select site_id, base, date, g, sum(g) over (partition by site_id, base order by date) as h
       from (select *, greatest(0, least(round(tmax*100), 3000) + least(round(tmin*100), 3000) - 200*base) as g
             from weather cross join (select distinct base from need))),
cand0 as ({candidates}),
st as (select c.*, p.h - p.g as p0 from cand0 c join pw p on p.site_id = c.site_id and p.base = c.base and p.date = c.start),
{", ".join(steps)},
grown as (select site_id, year, crop_id, variant, base, month, day, start, e0 - start + 1 as ini, e1 - e0 as dev,
         e2 - e1 as mid, e3 - e2 as late
       from g3 where e3 is not null
         and (select count(*) from weather w where w.site_id = g3.site_id and w.date between g3.start and g3.e3)
             = e3 - start + 1)"""


def cand_sql(dates: str) -> str:
    return f"""select n.*, cy.year, month, day, make_date(cy.year, month, day) as start
  from need n join cy using (site_id) cross join ({dates})"""


SHORT = "select unnest([2, 4, 9]) as month, unnest([15, 15, 1]) as day"
SWEEP = "select month(d) as month, day(d) as day from (select date '2001-01-01' + cast(unnest(range(0, 365, 15)) as int) as d)"
ONE = "select 4 as month, 15 as day"

SVP = "(0.6108*exp(17.27*({t})/(({t})+237.3)))"


def adjusted(kc: str, u2: str, rh: str) -> str:
    return (
        f"({kc} + (0.04*(greatest(1.0, least(6.0, {u2})) - 2.0) - 0.004*(greatest(20.0, least(80.0, {rh})) - 45.0))"
        " * power(greatest(0.1, least(10.0, height))/3.0, 0.3))"
    )


def seasons_sql(grown: str) -> str:
    kc = """case when k <= ini then kc_i when k <= ini+dev then kc_i + (k-ini)/greatest(dev,1)*(kc_m-kc_i)
  when k <= ini+dev+mid then kc_m else kc_m + (k-ini-dev-mid)/greatest(late,1)*(kc_e-kc_m) end"""
    rh = f"100.0*{SVP.format(t='tmin-2.0')}/{SVP.format(t='tmax')}"
    etc = ", ".join(f"coalesce(sum(etc) filter (where stage = {i}), 0) as etc{i}" for i in range(4))
    temps = ", ".join(f"avg((tmax+tmin)/2) filter (where stage = {i}) as temp{i}" for i in range(4))
    devs = ", ".join(
        f"case when temp{i} > high{i}+1.5 then temp{i}-(high{i}+1.5) when temp{i} < low{i}-1.5 "
        f"then (low{i}-1.5)-temp{i} else 0e0 end as d{i}"
        for i in range(4)
    )
    return f"""
gs as (select g.*, kc_ini, kc_mid, kc_end, height, frost_tolerant, heat_threshold, months, cast(g.ini+g.dev+g.mid+g.late as int) as total
       from {grown} g join crops c using (crop_id, variant)),
sd as (select *, {STAGE} as stage, wind_max/3.6*4.87/ln(67.8*10-5.42) as u2, {rh} as rh
       from (select gs.*, w.tmin, w.tmax, w.et0, w.precip, w.wind_max, w.date - start + 1 as k
             from gs join weather w on w.site_id = gs.site_id and w.date >= start and w.date < start + total)),
cond as (select site_id, year, crop_id, variant, month, day, avg(u2) filter (where stage = 2) as u2m,
         avg(rh) filter (where stage = 2) as rhm, avg(u2) filter (where stage = 3) as u2l,
         avg(rh) filter (where stage = 3) as rhl from sd group by all),
kcs as (select sd.*, u2m, rhm, 0.4*kc_ini as kc_i, {adjusted('kc_mid', 'u2m', 'rhm')} as kc_m,
         case when kc_end > 0.45 then {adjusted('kc_end', 'u2l', 'rhl')} else kc_end end as kc_e
       from sd join cond using (site_id, year, crop_id, variant, month, day)),
daily as (select *, ({kc})*et0 as etc from kcs),
tot as (select site_id, year, crop_id, variant, month, day, start, total as season_days, frost_tolerant, months,
         sum(et0) as et0_mm, sum(etc) as etc_mm, sum(precip) as rain_mm,
         greatest(0.0, sum(etc) - 0.5*sum(precip))/0.9 as gross_mm,
         any_value(kc_i) as kc_ini_used, any_value(kc_m) as kc_mid_used, any_value(kc_e) as kc_end_used,
         any_value(u2m) as u2_mid, any_value(rhm) as rhmin_mid,
         count(*) filter (where tmin <= 0) as frost_days, min(tmin) as coldest,
         count(*) filter (where tmax >= heat_threshold) as heat_days, max(tmax) as hottest, {etc}, {temps}
       from daily group by site_id, year, crop_id, variant, month, day, start, total, frost_tolerant, months
       having count(et0) = total),
fit as (select tot.*, env.* exclude (site_id, crop_id, variant, base), {devs}
       from tot join env using (site_id, crop_id, variant)),
seasons as (select *, greatest(d0, d1, d2, d3) as thermal_dev from fit)"""


SEASON_SELECT = """select site_id, year, crop_id, variant, month, day, start, start + cast(season_days - 1 as int) as "end", season_days,
  round(et0_mm, 6) as et0_mm, round(etc_mm, 6) as etc_mm, round(rain_mm, 6) as rain_mm, round(gross_mm, 6) as gross_mm,
  round(kc_ini_used, 6) as kc_ini_used, round(kc_mid_used, 6) as kc_mid_used, round(kc_end_used, 6) as kc_end_used,
  round(u2_mid, 6) as u2_mid, round(rhmin_mid, 6) as rhmin_mid, frost_days, round(coldest, 6) as coldest, heat_days,
  round(hottest, 6) as hottest, thermal_dev = 0 as thermal_ok,
  case when thermal_dev = 0 then null when d0 = thermal_dev then 0 when d1 = thermal_dev then 1
       when d2 = thermal_dev then 2 else 3 end as thermal_worst,
  round(thermal_dev, 9) as thermal_dev,
  round(etc0, 6) as etc0, round(etc1, 6) as etc1, round(etc2, 6) as etc2, round(etc3, 6) as etc3,
  round(temp0, 9) as temp0, round(temp1, 9) as temp1, round(temp2, 9) as temp2, round(temp3, 9) as temp3
from seasons"""


def water(name: str, sql: str, ctes: str = "", runs: str = RUNS) -> None:
    ORACLES[name] = f"with {WEATHER_SQL},\n{CROP_SQL},{runs}{',' + ctes if ctes else ''}\n{sql}"


water(
    "reference_runs",
    "select site_id, year, crop_id, variant, month_rank, month, base, "
    + ", ".join(f"round({c}{i}, {d}) as {c}{i}" for c, d in (("gdd", 6), ("temp", 9)) for i in range(4))
    + " from runs",
)
water(
    "gdd_requirement",
    "select site_id, crop_id, variant, base, years, "
    + ", ".join(f"round(need{i}, 6) as need{i}" for i in range(4))
    + " from need",
)
water(
    "thermal_envelope",
    "select site_id, crop_id, variant, base, "
    + ", ".join(f"round({c}{i}, 9) as {c}{i}" for c in ("low", "high") for i in range(4))
    + " from env",
)
water(
    "stage_lengths",
    "select site_id, year, crop_id, variant, month, day, ini, dev, mid, late from grown",
    grown_sql(cand_sql(SHORT)),
)
water("season_run", SEASON_SELECT, grown_sql(cand_sql(SHORT)) + "," + seasons_sql("grown"))
water(
    "fixed_length_seasons",
    SEASON_SELECT,
    f"""
fixed as (select c.site_id, c.year, c.crop_id, c.variant, c.month, c.day, c.start, v.ini, v.dev, v.mid, v.late
       from ({cand_sql(SHORT)}) c join crops v using (crop_id, variant)),"""
    + seasons_sql("fixed"),
)
water(
    "planting_sweep",
    """select site_id, crop_id, variant, month, day, years, days,
  strftime(make_date(2001, month, day) + cast(days - 1 as int), '%d %b') as harvest,
  round(gm, 6) as gross_median, round(ga, 6) as gross_min, round(gb, 6) as gross_max, frost_years, thermal_bad,
  case when not frost_tolerant and frost_years/years > 0.10 then 'F' else '' end
    || case when thermal_bad/years > 0.20 then 'T' else '' end as flags,
  list_contains(months, month) as published_month
from (select site_id, crop_id, variant, month, day, count(*) as years, cast(floor(median(season_days)) as int) as days,
        median(gross_mm) as gm, min(gross_mm) as ga, max(gross_mm) as gb,
        count(*) filter (where frost_days > 0) as frost_years,
        greatest(count(*) filter (where thermal_dev > 0), count(*) filter (where heat_days > 20)) as thermal_bad,
        any_value(frost_tolerant) as frost_tolerant, any_value(months) as months
      from seasons group by 1, 2, 3, 4, 5)""",
    grown_sql(cand_sql(SWEEP)) + "," + seasons_sql("grown"),
)
_WATER_COLUMNS = ", ".join(
    f"round(median({c}), 6) as {c}_median, round(min({c}), 6) as {c}_min, round(max({c}), 6) as {c}_max"
    for c in ("et0_mm", "etc_mm", "rain_mm", "gross_mm")
)
water(
    "planting_summary",
    f"""select site_id, crop_id, variant, month, day, count(*) as years,
  cast(floor(median(season_days)) as int) as days_median, min(season_days) as days_min, max(season_days) as days_max,
  count(*) filter (where frost_days > 0) as frost_years, round(min(coldest), 6) as coldest,
  count(*) filter (where thermal_dev = 0) as inside_years,
  round(avg(kc_ini_used), 6) as kc_ini, round(avg(kc_mid_used), 6) as kc_mid, round(avg(kc_end_used), 6) as kc_end,
  {_WATER_COLUMNS}, '15 Apr' as planted,
  count(*) filter (where frost_days > 0) > 0 and not any_value(frost_tolerant) as exposed,
  round(any_value(wd), 9) as worst_departure,
  ['initial','development','mid-season','late'][any_value(ws)] as worst_stage,
  round(any_value([t0,t1,t2,t3][ws]), 9) as worst_temp,
  round(any_value([l0,l1,l2,l3][ws]), 9) as envelope_low, round(any_value([h0,h1,h2,h3][ws]), 9) as envelope_high,
  round(median(gross_mm)*15, 6) as m3_15_dunum, round(median(gross_mm)*20, 6) as m3_20_dunum
from seasons left join bad using (site_id, crop_id, variant)
group by 1, 2, 3, 4, 5""",
    grown_sql(cand_sql(ONE))
    + ","
    + seasons_sql("grown")
    + """,
bad as (select site_id, crop_id, variant, thermal_dev as wd, temp0 as t0, temp1 as t1, temp2 as t2, temp3 as t3,
          low0 as l0, low1 as l1, low2 as l2, low3 as l3, high0 as h0, high1 as h1, high2 as h2, high3 as h3,
          case thermal_dev when d0 then 1 when d1 then 2 when d2 then 3 else 4 end as ws
        from seasons where thermal_dev > 0
        qualify row_number() over (partition by site_id, crop_id, variant order by thermal_dev desc, year) = 1)""",
)
water(
    "gdd_sensitivity",
    """select n.site_id, n.crop_id, n.variant, n.base, round(need0+need1+need2+need3, 4) as gdd_total,
  coalesce(g.ini+g.dev+g.mid+g.late, 0) as season_days
from need n left join grown g using (site_id, crop_id, variant, base)""",
    grown_sql("""select n.*, y.year, months[1] as month, 15 as day, make_date(y.year, months[1], 15) as start
  from need n join crops using (crop_id, variant)
  join (select site_id, list_sort(list(year))[count(*)//2 + 1] as year from cy group by 1) y using (site_id)"""),
    runs_sql("5.0e0, 10.0e0, 12.0e0"),
)

ORACLES["yield_summary"] = """with c as (
  select distinct 'crop' || p_size as crop, cast(p_size % 9 as varchar) as item_code, 'item ' || (p_size % 9) as label from part),
y as (select cast(l_partkey % 7 as varchar) as item_code, year(l_shipdate) as year, l_quantity as value,
        case when l_partkey % 7 = 6 then 'bushels'
             else ['hg/ha', 'kg/ha', 't / ha', '100 g/ha'][l_linenumber % 4 + 1] end as unit from lineitem),
k as (select *, case unit when 'hg/ha' then value*0.1/10 when '100 g/ha' then value*0.1/10 when 'kg/ha' then value/10
        when 't / ha' then value*100 end as kg from y),
s as (select item_code, median(kg) as med, min(kg) as lo, max(kg) as hi, min(year) filter (where kg is not null) as first_year,
        max(year) filter (where kg is not null) as last_year, count(kg) as n, arg_min(unit, (year, value, unit)) as unit_reported
      from k group by 1)
select crop, round(med, 1) as kg_per_dunum, round(lo, 1) as min, round(hi, 1) as max, first_year, last_year,
  coalesce(n, 0) as n, label, unit_reported, cast(null as varchar) as caveat,
  case when unit_reported is null then 'No yield rows returned.'
       when med is null then 'Unrecognised unit ''' || unit_reported || '''.' end as note
from c left join s using (item_code)"""
