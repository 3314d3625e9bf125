import datetime as dt
import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marketclime.operators import climate, ingest, yields

DDL = (
    "site_id string, date date, tmin double, tmax double, et0 double, precip double, wind_mean double, "
    "wind_max double, source string"
)


def make_days(seed=1, first=dt.date(1999, 1, 1), last=dt.date(2003, 3, 1), site="s", gaps=True):
    rng = random.Random(seed)
    out, day = [], first
    while day <= last:
        season = abs(day.timetuple().tm_yday - 200)
        tmax = round(34 - 0.11 * season + rng.uniform(-4, 4), 2)
        tmin = round(tmax - rng.uniform(6, 13), 2)
        row = [site, day, tmin, tmax, round(rng.uniform(1, 8), 2), float(rng.choice([0, 0, 0, 5])), None, 12.0]
        if gaps and rng.random() < 0.004:
            row[rng.choice([2, 3, 4, 5])] = None
        if not (gaps and day.year == 2001 and rng.random() < 0.05):  # 2001 is not complete
            out.append((*row, "era5_archive" if day < dt.date(2003, 2, 1) else "preliminary"))
        day += dt.timedelta(days=1)
    return out


@pytest.fixture(scope="module")
def days():
    return make_days(1) + make_days(2, site="t", gaps=False)


@pytest.fixture(scope="module")
def weather(spark, days):
    return spark.createDataFrame(days, DDL).repartition(5)


def years_of(days, *columns):
    index = {"tmin": 2, "tmax": 3, "et0": 4}
    counts = defaultdict(int)
    for row in days:
        if row[-1] == "era5_archive" and all(row[index[c]] is not None for c in columns):
            counts[row[0], row[1].year] += 1
    return {k for k, n in counts.items() if n >= 360}


def test_three_kinds_of_complete_year(spark, weather, days):
    for columns in ([], ["tmax"], ["et0"]):
        got = {(r.site_id, r.year) for r in climate.complete_years(weather, columns).collect()}
        assert got == years_of(days, *columns)
    edge = [("s", dt.date(2001, 1, 1) + dt.timedelta(days=i), 1.0, 2.0, 3.0, None, None, None, "era5_archive") for i in range(360)]
    assert climate.complete_years(spark.createDataFrame(edge, DDL)).count() == 1
    assert climate.complete_years(spark.createDataFrame(edge[:-1], DDL)).count() == 0


def test_climatologies(weather, days):
    full = years_of(days)
    n = defaultdict(int)
    for site, _ in full:
        n[site] += 1
    usable = [d for d in days if d[-1] == "era5_archive" and (d[0], d[1].year) in full]
    for r in climate.monthly_climatology_totals(weather).collect():
        here = [d for d in usable if d[0] == r.site_id and d[1].month == r.month]
        assert r.tmax_mean_c == pytest.approx(statistics.mean(d[3] for d in here if d[3] is not None))
        assert r.rain_mean_mm == pytest.approx(sum(d[5] for d in here if d[5] is not None) / n[r.site_id])
    for r in climate.heat_days(weather).collect():
        here = [d for d in usable if d[0] == r.site_id and d[1].month == r.month and d[3] is not None]
        assert r.days_per_year == pytest.approx(sum(d[3] >= r.threshold for d in here) / n[r.site_id])
    table = climate.monthly_climatology(weather).collect()
    assert len(table) == 24
    full = years_of(days, "tmax")
    for r in table:
        here = [
            d
            for d in days
            if d[-1] == "era5_archive" and d[3] is not None and (d[0], d[1].year) in full and d[0] == r.site_id and d[1].month == r.month
        ]
        n_years = len([1 for s, _ in full if s == r.site_id])
        assert r.et0 == pytest.approx(sum(d[4] or 0.0 for d in here) / n_years)
        assert r.frost_nights == pytest.approx(sum(d[2] is not None and d[2] <= 0 for d in here) / n_years)


def test_months_without_days_are_null(spark):
    some = [
        ("s", dt.date(2001, 1, 1) + dt.timedelta(days=i), 1.0, 2.0, 3.0, 1.0, None, None, "era5_archive") for i in range(300)
    ]
    got = climate.monthly_climatology(spark.createDataFrame(some, DDL), min_days=300).collect()
    assert len(got) == 12 and {r.month for r in got if r.tmax is None} == {11, 12}


def test_frost(weather, days):
    full = years_of(days)
    spring, autumn = defaultdict(dict), defaultdict(dict)
    for site, day, tmin, *_, source in days:
        if source != "era5_archive" or (site, day.year) not in full or tmin is None:
            continue
        doy = day.timetuple().tm_yday
        for thr in climate.FROST_THRESHOLDS:
            if tmin <= thr and day.month <= 6:
                spring[site, thr][day.year] = max(spring[site, thr].get(day.year, 0), doy)
            if tmin <= thr and day.month >= 7:
                autumn[site, thr][day.year] = min(autumn[site, thr].get(day.year, 400), doy)
    got = {(r.site_id, r.threshold): r for r in climate.frost_summary(weather).collect()}
    assert len(got) == 6
    for key, r in got.items():
        s, a = spring[key], autumn[key]
        assert (r.spring_years, r.autumn_years) == (len(s), len(a))
        assert r.spring_max == max(s.values(), default=None) and r.autumn_min == min(a.values(), default=None)
        free = [a[y] - s[y] for y in a if y in s]
        assert r.frost_free_median == (statistics.median(free) if free else None)
        if s:
            assert r.spring_p50 <= r.spring_p90 <= r.spring_max


def test_hydrological_years(weather, days):
    rain, count = defaultdict(float), defaultdict(int)
    for site, day, *_, precip, _, _, source in days:
        if source == "era5_archive" and precip is not None:
            key = (site, day.year if day.month >= 10 else day.year - 1)
            rain[key] += precip
            count[key] += 1
    seasons = climate.hydro_rain(weather)
    got = {(r.site_id, r.season): r.rain_mm for r in seasons.collect()}
    assert got == {k: pytest.approx(v) for k, v in rain.items() if count[k] >= 360}
    lenient = {(r.site_id, r.season) for r in climate.hydro_rain(weather, null_as_zero=True, require=["tmax"]).collect()}
    assert set(got) - lenient == set() or len(lenient) > 0
    ends = climate.extreme_seasons(seasons, 1).collect()
    assert len(ends) == 2 * len({k[0] for k in got})


def test_committed_rain_seasons_percentiles(spark):
    """Quartiles interpolate on n - 1."""
    df = spark.createDataFrame([("s", y, float(v), 365) for y, v in enumerate([1, 2, 4, 8])], "site_id string, season int, rain_mm double, days int")
    r = climate.hydro_rain_distribution(df).first()
    assert (r.driest, r.p25, r.median, r.p75, r.wettest) == (1.0, 1.75, 3.0, 5.0, 8.0)


@pytest.mark.parametrize("month, day", [(3, 15), (11, 1), (2, 29)])
def test_days_to_heat_totals(weather, days, month, day):
    full = years_of(days)
    known = {
        (d[0], d[1]): d for d in days if d[-1] == "era5_archive" and (d[0], d[1].year) in full and None not in (d[2], d[3])
    }
    hits = defaultdict(list)
    for site, year in full:
        try:
            start = dt.date(year, month, day)
        except ValueError:
            continue
        total, reached = 0.0, {}
        for offset in range(365):
            d = known.get((site, start + dt.timedelta(days=offset)))
            if d:
                total += max(0.0, (d[2] + d[3]) / 2 - 10)
                for t in climate.GDD_TARGETS:
                    if total >= t:
                        reached.setdefault(t, offset + 1)
        for t, n in reached.items():
            hits[site, float(t)].append(n)
    got = {(r.site_id, r.target): r for r in climate.gdd_days_to_target(weather, month, day).collect()}
    assert set(got) == set(hits)
    for key, r in got.items():
        v = hits[key]
        assert (r.median_days, r.fastest, r.slowest, r.years) == (statistics.median(v), min(v), max(v), len(v))


def test_weather_checks_use_the_upper_median(spark):
    rows = [("s", dt.date(y, 1, 1), -1.0, 9.0, 1.0, float(y - 1999), None, None, "era5_archive") for y in range(2000, 2005)]
    r = climate.weather_checks(spark.createDataFrame(rows, DDL)).first()
    assert (r.rain_min, r.rain_median, r.rain_max) == (2.0, 4.0, 5.0)  # 2000 is the first year
    assert (r.min_tmin, r.frost_days, r.years) == (-1.0, 5, 5)


def test_archive_wins_over_preliminary(spark):
    ddl = "site_id string, date date, tmax double, ordinal long"
    day = [dt.date(2020, 1, i) for i in range(1, 5)]
    archive = spark.createDataFrame([("s", day[0], 1.0, 1), ("s", day[1], None, 2), ("s", day[3], 4.0, 3), ("s", day[3], 5.0, 4)], ddl)
    recent = spark.createDataFrame([("s", day[0], 9.0, 9), ("s", day[1], 8.0, 9), ("s", day[2], 7.0, 9)], ddl)
    got = {r.date.day: (r.tmax, r.source) for r in ingest.merge_weather(archive, recent).collect()}
    assert got == {1: (1.0, "era5_archive"), 2: (8.0, "preliminary"), 3: (7.0, "preliminary"), 4: (5.0, "era5_archive")}


def test_ingest_joins(spark, rows):
    stored = rows((1, "2020-01-01", "a", 1, 2, 3, 1), (2, "2020-01-01", "a", 1, 2, 3, 1))
    batch = rows((3, "2020-01-01", "a", 1, 2, 3, 1), (4, "2020-01-02", "a", 1, 2, 3, 1), (5, "2020-01-02", "a", 1, 9, 9, 1))
    assert sorted(r.ordinal for r in ingest.new_rows(batch, stored).collect()) == [4, 5]
    assert [r.ordinal for r in ingest.new_rows(batch, stored, dedupe_batch=True).collect()] == [4]
    assert ingest.upsert_new_rows(stored, batch).count() == 4
    merged = ingest.upsert_new_rows(stored, batch, dedupe_batch=True)
    assert ingest.upsert_new_rows(merged, batch, dedupe_batch=True).count() == merged.count() == 3


def test_wanted_days_skip_fridays_known_days_and_known_gaps(spark):
    have = spark.createDataFrame([(dt.date(2026, 8, 5),)], "date date")
    closed = spark.createDataFrame([(dt.date(2026, 8, 4),)], "date date")
    today = F.lit("2026-08-10").cast("date")
    got = [r.date.day for r in ingest.wanted_days(today, have, closed, lookback=8, max_fetch=4).collect()]
    assert got == [9, 8, 6, 3]  # the 7th is a Friday; newest first; at most four
    state = ingest.observation_state(have, closed)
    later = ingest.update_state(state, have, spark.createDataFrame([(dt.date(2026, 8, 1),)], "date date")).first()
    assert later.no_bulletin == [dt.date(2026, 8, 1), dt.date(2026, 8, 4)] and later.days_with_data == 1


def test_unfetched_days(spark):
    bounds = spark.createDataFrame([(dt.date(2026, 8, 5), dt.date(2026, 8, 9))], "first date, last date")
    entries = [(dt.date(2026, 8, 5), "ok"), (dt.date(2026, 8, 6), "failed"), (dt.date(2026, 8, 8), "empty_confirmed")]
    checkpoint = spark.createDataFrame(entries, "day date, status string")
    assert sorted(r.date.day for r in ingest.unfetched_days(bounds, checkpoint).collect()) == [6, 9]


def test_yield_summary(spark):
    crops = [("a", "1", "A", None), ("b", "1", "A", "shared"), ("c", "2", "C", None), ("d", "9", "D", None)]
    rows = [("1", 2001, 100.0, "hg/ha"), ("1", 2003, 30.0, "kg/ha"), ("1", 2002, 0.02, "t/ha"), ("2", 2001, 5.0, "bu")]
    got = {
        r.crop: r
        for r in yields.yield_summary(
            spark.createDataFrame(crops, "crop string, item_code string, label string, caveat string"),
            spark.createDataFrame(rows, "item_code string, year int, value double, unit string"),
        ).collect()
    }
    assert (got["a"].kg_per_dunum, got["a"].min, got["a"].max, got["a"].n) == (2.0, 1.0, 3.0, 3)
    assert (got["b"].first_year, got["b"].last_year, got["b"].unit_reported) == (2001, 2003, "hg/ha")
    assert got["c"].kg_per_dunum is None and got["c"].note == "Unrecognised unit 'bu'." and got["c"].n == 0
    assert got["d"].note == "No yield rows returned."
