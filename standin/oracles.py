"""SQL for each registered query, over the same tables."""

from __future__ import annotations

from standin.views import CLEAN_SQL, OBS_SQL

MONTHS = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"

ORACLES: dict[str, str] = {}


def obs(name: str, sql: str, ctes: str = "") -> None:
    ORACLES[name] = f"with {OBS_SQL}{',' + ctes if ctes else ''}\n{sql}"


def cleaned(name: str, sql: str, ctes: str = "") -> None:
    ORACLES[name] = f"with {CLEAN_SQL}{',' + ctes if ctes else ''}\n{sql}"


obs(
    "flag_duplicates",
    """select date, item, ordinal,
  case when row_number() over (partition by date, item order by ordinal) > 1 then 1 else 0 end as duplicate
from obs""",
)
obs(
    "duplicate_audit",
    """select count(*) as duplicate_keys, sum(n - 1) as extra_rows,
  count(*) filter (where v = 1) as identical_keys, count(*) filter (where v > 1) as conflicting_keys
from (select date, item, count(*) as n,
        count(distinct (price_low, price_mode, price_high, quantity)) as v
      from obs group by date, item having count(*) > 1)""",
)
obs(
    "conflicting_examples",
    """select date, item, round(price_low, 4) as price_low, round(price_mode, 4) as price_mode,
  round(price_high, 4) as price_high, quantity
from obs where (date, item) in (
  select (date, item) from obs group by date, item
  having count(distinct (price_low, price_mode, price_high)) > 1)""",
)
obs(
    "column_order_audit",
    """, t as (select unnest([0,1,2]) as position,
    unnest(['price_high','price_mode','price_low']) as parsed_as,
    unnest([(price_mode > price_high)::int + (price_low > price_high)::int,
            (price_high > price_mode)::int + (price_low > price_mode)::int,
            (price_high > price_low)::int + (price_mode > price_low)::int]) as r
  from obs where price_high <> price_mode and price_mode <> price_low and price_high <> price_low)
select position, parsed_as, round(avg((r=0)::int), 4) as largest, round(avg((r=1)::int), 4) as middle,
  round(avg((r=2)::int), 4) as smallest, count(*) as ranked_rows
from t group by 1, 2""",
)
ORACLES["column_order_audit"] = ORACLES["column_order_audit"].replace("\n, t as", ", t as")
cleaned(
    "mad_thresholds",
    "select item, n as values, round(med, 3) as median, round(scale, 3) as scale from thr",
)
cleaned(
    "flag_outliers",
    """select date, o.item, ordinal,
  case when med is not null and abs(price_mode - med) > 2*scale then 1 else 0 end as outlier
from obs o left join thr using (item)""",
)
obs(
    "rolling_outliers",
    """select date, o.item, ordinal,
  case when m is not null and abs(price_mode - m) > 2.5*s then 1 else 0 end as outlier
from obs o left join lt using (item, date)""",
    """
f as (select item, date, arg_min(price_mode, ordinal) as v from obs where price_mode > 0 group by item, date),
w as (select a.item, a.date, median(b.v) as m, count(*) as n
      from f a join f b on a.item = b.item and b.date between a.date - 10 and a.date + 10
      group by a.item, a.date),
lt as (select w.item, w.date, any_value(m) as m, 1.4826*median(abs(b.v - m)) as s
       from w join f b on w.item = b.item and b.date between w.date - 10 and w.date + 10
       where n >= 3 group by w.item, w.date having s > 0)""",
)
obs(
    "missing_audit",
    """select count(*) as rows,
  count(*) filter (where price_low is null or price_mode is null or price_high is null) as missing_price,
  count(*) filter (where price_low = 0 or price_mode = 0 or price_high = 0) as zero_price,
  count(*) filter (where quantity is null or quantity = 0) as no_quantity
from obs""",
)
cleaned("clean_prices", "select date, item, ordinal, order_ok, outlier, duplicate, usable from clean")
cleaned(
    "cleaning_summary",
    """select count(*) as rows, sum(outlier) as outliers, sum(duplicate) as duplicates, sum(usable) as usable,
  round(avg(usable), 4) as usable_share from clean""",
)
cleaned(
    "apply_merges",
    """select regexp_replace(item, '^new ', 'old ') as item, item as item_raw, count(*) as rows,
  sum(usable) as usable, sum(duplicate) as duplicates
from clean group by 1, 2""",
)
obs(
    "first_row_distinct",
    """select date, item, ordinal, price_mode, quantity from obs
qualify row_number() over (partition by date, item order by ordinal) = 1""",
)
cleaned(
    "weekly_prices",
    """select item, week, round(median(price_mode), 6) as mode, round(median(price_low), 6) as low,
  round(median(price_high), 6) as high, round(median(quantity), 6) as qty_t, count(*) as n, week_start
from us group by item, week, week_start""",
)
cleaned(
    "seasonal_profile",
    """select item, week_of_year, round(quantile_cont(price_mode, 0.10), 6) as p10,
  round(quantile_cont(price_mode, 0.25), 6) as p25, round(quantile_cont(price_mode, 0.50), 6) as median,
  round(quantile_cont(price_mode, 0.75), 6) as p75, round(quantile_cont(price_mode, 0.90), 6) as p90,
  round(median(quantity), 6) as qty_t, count(*) as n
from us group by item, week_of_year having count(*) >= 4""",
)
cleaned(
    "series_index",
    """select printf('s%03d', number) as series_id, s.item, crop_id as crop, days, "first", "last",
  round(median_price, 4) as median_price, round(median_qty_t, 4) as median_qty_t,
  crop_id is not null as mapped
from (select item, count(distinct date) as days, min(date) as "first", max(date) as "last",
        median(price_mode) as median_price, median(quantity) as median_qty_t,
        row_number() over (order by count(*) desc, min(ordinal)) - 1 as number
      from us group by item) s left join crops_of using (item)
where days >= 150""",
)
cleaned(
    "market_days",
    """select max(date) as latest, max(date) filter (where date < (select max(date) from us)) as previous from us""",
)
cleaned(
    "latest_snapshot",
    """select t.item, crop_id as crop, round(t.price_low, 4) as low, round(t.price_mode, 4) as mode,
  round(t.price_high, 4) as high, round(t.quantity_listed, 4) as qty_t, round(pm, 4) as prev_mode,
  round(100*(t.price_mode - pm)/pm, 4) as change_pct,
  case when coalesce(week_n, 0) >= 4 then round(week_median, 4) end as week_median,
  coalesce(week_n, 0) as week_n
from t left join p using (item) left join h using (item) left join crops_of using (item)""",
    """
d as (select max(date) as latest, max(date) filter (where date < (select max(date) from us)) as previous from us),
t as (select * from us where date = (select latest from d)
      qualify row_number() over (partition by item order by ordinal) = 1),
p as (select item, arg_min(price_mode, ordinal) as pm from us where date = (select previous from d) group by item),
h as (select item, median(price_mode) as week_median, count(*) as week_n from us
      where date <> (select latest from d)
        and week_of_year = (select any_value(week_of_year) from us where date = (select latest from d))
      group by item)""",
)
obs(
    "near_duplicate_pairs",
    """select item_a, item_b, edit_distance, days_a, days_b, shared_days,
  round(shared_days / least(days_a, days_b), 4) as cooccurrence_rate,
  case when shared_days / least(days_a, days_b) > 0.05 then 'DIFFERENT (co-occur)' else 'possible rename' end as verdict,
  '' as decision
from (select a.item as item_a, b.item as item_b, levenshtein(a.item, b.item) as edit_distance,
        a.days as days_a, b.days as days_b,
        (select count(*) from ds x join ds y using (date) where x.item = a.item and y.item = b.item) as shared_days
      from it a join it b on a.place < b.place and levenshtein(a.item, b.item) <= 2)""",
    """
ds as (select distinct item, date from obs),
it as (select item, count(distinct date) as days,
         row_number() over (order by count(distinct date) desc, min(ordinal)) as place
       from obs group by item)""",
)
ORACLES["near_duplicate_pairs"] = ORACLES["near_duplicate_pairs"].replace(
    "days_b), 4) as cooccurrence_rate", "days_b), 3) as cooccurrence_rate"
)
obs(
    "exact_name_groups",
    """select norm, item, days, members, coalesce(m, 0) as max_shared_days,
  case when coalesce(m, 0) > 10 then 'CO-OCCUR, different products' else 'likely same, safe to merge' end as verdict
from it join (select norm, count(*) as members from it group by norm having count(*) > 1) using (norm)
left join tog using (norm)""",
    """
sp as (select case ordinal % 3 when 0 then replace(item, ' ', '  ')
         when 1 then replace(replace(item, ' ', ' ' || chr(1600) || chr(8203)), 'o', chr(65359)) else item end as item,
         item as norm, date from obs),
ds as (select distinct item, norm, date from sp),
it as (select item, norm, count(*) as days from ds group by item, norm),
tog as (select norm, max(c) as m from
  (select a.norm, a.item, b.item, count(*) as c from ds a join ds b on a.norm = b.norm and a.date = b.date
     and a.item < b.item group by 1, 2, 3) group by norm)""",
)
_PROFILE = f"""
good as (select * from obs where order_ok is null or order_ok <> 0),
mon as (select item, month(date) as m, median(price_mode) as p, min(ordinal) as o
        from good where price_mode is not null group by 1, 2 having count(*) >= 5),
pk as (select item, arg_max(m, (p, -o)) as hi, arg_min(m, (p, o)) as lo from mon group by item having count(*) >= 6),
st as (select item, median(price_mode) as mp, median(quantity) as mq from good group by item),
prof as (
  select s.item, coalesce(crop_id, '') as crop_id, days_seen, first_seen, last_seen,
    round(mp, 4) as median_mode_price, {MONTHS}[hi] as peak_month, {MONTHS}[lo] as trough_month,
    round(mq, 4) as median_qty_t, '' as notes, flagged,
    year(first_seen) || '-' || year(last_seen) as span, first_ordinal
  from (select item, count(*) as days_seen, min(date) as first_seen, max(date) as last_seen, min(ordinal) as first_ordinal,
          count(*) filter (where order_ok = 0) as flagged from obs group by item) s
  left join st using (item) left join pk using (item)
  left join (select distinct p_name as item,
    case split_part(p_name, ' ', 2) when 'rod' then '' when 'ring' then 'ignore'
         else split_part(p_name, ' ', 2) end as crop_id from part) using (item))"""
obs("item_profile", "select * exclude (first_ordinal) from prof", _PROFILE)
obs("top_items", "select item, days_seen, span from prof order by days_seen desc, first_ordinal limit 30", _PROFILE)
obs(
    "mapping_coverage",
    """select (select count(*) from obs) as rows_read, sum(days_seen) as dated_rows, count(*) as distinct_items, count(*) as items,
  count(*) filter (where crop_id <> '') as mapped, count(*) filter (where days_seen < 100) as thin_items
from prof""",
    _PROFILE,
)
ORACLES["crop_members"] = """with m as (select distinct p_name as item, split_part(p_name, ' ', 2) as crop_id from part)
select crop_id, string_agg(item, '|' order by item) as members, count(*) as n
from m where crop_id not in ('rod', 'ring') group by crop_id"""
obs(
    "parse_summary",
    """select count(*) as rows, min(date) as "first", max(date) as "last", count(distinct date) as days,
  count(*) filter (where order_ok = 0) as order_failures, count(*) filter (where order_ok is null) as missing_price,
  count(distinct item) as items
from obs""",
)
obs("parse_report_units", "select unit, count(*) as rows from obs group by unit")
obs(
    "order_failures_by_year",
    """select year(date) as year, count(*) filter (where order_ok = 0) as failures, count(*) as total
from obs group by 1""",
)
obs(
    "failing_rows",
    """select date, item, round(price_low, 4) as price_low, round(price_mode, 4) as price_mode,
  round(price_high, 4) as price_high
from obs where order_ok = 0 order by date, item, ordinal limit 5""",
)
obs("days_per_year", "select year(date) as year, count(distinct date) as days from obs group by 1")
obs("frequent_items", "select item, count(*) as rows from obs group by item order by rows desc, min(ordinal) limit 15")
