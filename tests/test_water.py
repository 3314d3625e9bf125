"""Water demand against a plain-Python restatement on random weather."""

import datetime as dt
import math
import statistics

import pytest
from pyspark.sql import functions as F

from marketclime.operators import water
from tests.test_climate import DDL, make_days

CROPS = [
    ("alpha", 0, 20, 30, 30, 15, [4, 6], 0.6, 1.05, 0.9, 0.7, False, 33.0),
    ("alpha", 1, 25, 30, 40, 20, [10], 0.6, 1.05, 0.9, 0.7, False, 33.0),
    ("beta", 0, 25, 25, 30, 10, [3], 0.7, 1.1, 0.4, 0.4, True, None),
]
CROP_DDL = (
    "crop_id string, variant int, ini int, dev int, mid int, late int, months array<int>, kc_ini double, kc_mid double, "
    "kc_end double, height double, frost_tolerant boolean, heat_threshold double"
)
BASE, CAP = 9.0, 31.0


class Site:
    def __init__(self, days):
        self.by_date = {d[1]: d for d in days}
        counts = {}
        for d in days:
            if d[-1] == "era5_archive" and d[4] is not None:
                counts[d[1].year] = counts.get(d[1].year, 0) + 1
        self.years = sorted(y for y, n in counts.items() if n >= 360)

    def heat(self, day):
        d = self.by_date.get(day)
        if d is None or d[2] is None or d[3] is None:
            return None
        return max(0.0, (min(d[3], CAP) + min(d[2], CAP)) / 2 - BASE)

    def reference(self, crop, month, year):
        start, used, sums, temps = dt.date(year, month, 15), 0, [], []
        for length in crop[2:6]:
            stage = [start + dt.timedelta(days=used + i) for i in range(length)]
            used += length
            heats = [self.heat(x) for x in stage]
            if None in heats:
                return None
            sums.append(sum(heats))
            temps.append(statistics.mean((self.by_date[x][2] + self.by_date[x][3]) / 2 for x in stage))
        return sums, temps

    def requirement(self, crop):
        runs = [r for r in (self.reference(crop, crop[6][0], y) for y in self.years) if r]
        return [statistics.mean(r[0][i] for r in runs) for i in range(4)] if runs else None

    def envelope(self, crop):
        temps = [r[1] for y in self.years if (r := self.reference(crop, crop[6][0], y))]
        for other in CROPS:
            if other[0] == crop[0] and other[1] != crop[1]:
                temps += [r[1] for m in other[6] for y in self.years if (r := self.reference(other, m, y))]
        return [(min(t[i] for t in temps), max(t[i] for t in temps)) for i in range(4)]

    def lengths(self, start, needs):
        used, out = 0, []
        for need in needs:
            got, n = 0.0, 0
            while got < need:
                h = self.heat(start + dt.timedelta(days=used))
                if h is None or used + 1 > 400:
                    return None
                got, n, used = got + h, n + 1, used + 1
            out.append(n)
        return out

    def season(self, crop, start, lengths, fw=0.4, eff=0.9, rain=0.5):
        total = sum(lengths)
        days = [self.by_date.get(start + dt.timedelta(days=i)) for i in range(total)]
        if any(d is None or d[4] is None for d in days):
            return None
        ends = [sum(lengths[: i + 1]) for i in range(4)]
        mid, late = days[ends[1] : ends[2]], days[ends[2] :] or days[ends[1] : ends[2]]

        def svp(t):
            return 0.6108 * math.exp(17.27 * t / (t + 237.3))

        def adjusted(kc, stage):
            winds = [(d[6] if d[6] is not None else d[7]) / 3.6 * 4.87 / math.log(672.58) for d in stage if d[6] or d[7]]
            hums = [100 * svp(d[2] - 2) / svp(d[3]) for d in stage if d[2] is not None and d[3] is not None]
            if not winds or not hums:
                return kc
            u, h = min(6, max(1, statistics.mean(winds))), min(80, max(20, statistics.mean(hums)))
            return kc + (0.04 * (u - 2) - 0.004 * (h - 45)) * (min(10, max(0.1, crop[10])) / 3) ** 0.3

        first, middle = fw * crop[7], adjusted(crop[8], mid)
        last = adjusted(crop[9], late) if crop[9] > 0.45 else crop[9]
        etc, stages = [0.0] * 4, [[] for _ in range(4)]
        for k, d in enumerate(days, 1):
            s = next(i for i in range(4) if k <= ends[i])
            before = ends[s - 1] if s else 0
            share = (k - before) / max(lengths[s], 1)
            kc = [first, first + share * (middle - first), middle, middle + share * (last - middle)][s]
            etc[s] += kc * d[4]
            if d[2] is not None and d[3] is not None:
                stages[s].append((d[2] + d[3]) / 2)
        wet = sum(d[5] or 0 for d in days)
        return {
            "days": total,
            "etc": etc,
            "gross": max(0, sum(etc) - rain * wet) / eff,
            "frost": sum(d[2] is not None and d[2] <= 0 for d in days),
            "heat": sum(crop[12] is not None and d[3] is not None and d[3] >= crop[12] for d in days),
            "temps": [statistics.mean(t) if t else None for t in stages],
        }


@pytest.fixture(scope="module")
def data():
    return {s: make_days(seed, site=s, last=dt.date(2004, 6, 1)) for s, seed in (("s", 21), ("t", 22))}


@pytest.fixture(scope="module")
def sites(data):
    return {s: Site(d) for s, d in data.items()}


@pytest.fixture(scope="module")
def setup(spark, data):
    weather = spark.createDataFrame([r for d in data.values() for r in d], DDL).repartition(6)
    variants = spark.createDataFrame(CROPS, CROP_DDL)
    years = water.calibration_years(weather)
    return weather, years, variants, water.calibrated_variants(weather, years, variants, BASE, CAP)


def test_calibration(setup, sites):
    got = {(r.site_id, r.crop_id, r.variant): r for r in setup[3].collect()}
    for s, site in sites.items():
        for crop in CROPS:
            needs = site.requirement(crop)
            if needs is None:
                assert (s, *crop[:2]) not in got
                continue
            row = got[s, crop[0], crop[1]]
            assert row.requirement == pytest.approx(needs)
            assert list(zip(row.lowest, row.highest)) == [pytest.approx(e) for e in site.envelope(crop)]


def expected_seasons(sites, dates, fixed=False):
    out = {}
    for s, site in sites.items():
        for crop in CROPS:
            needs = site.requirement(crop)
            if needs is None:
                continue
            bounds = site.envelope(crop)
            for year in site.years:
                for month, day in dates:
                    try:
                        start = dt.date(year, month, day)
                    except ValueError:
                        continue
                    lengths = list(crop[2:6]) if fixed else site.lengths(start, needs)
                    run = lengths and site.season(crop, start, lengths)
                    if run:
                        off = [
                            max(0.0, t - hi - 1.5, lo - 1.5 - t) if t is not None else 0.0
                            for t, (lo, hi) in zip(run["temps"], bounds)
                        ]
                        run["dev"] = max(off)
                        run["worst"] = off.index(max(off)) if max(off) > 0 else None
                        out[s, crop[0], crop[1], year, month, day] = (lengths, run)
    return out


@pytest.mark.parametrize("fixed", [False, True])
def test_seasons(setup, sites, fixed):
    weather, years, variants, calibrated = setup
    dates = [(1, 5), (2, 29), (4, 15), (9, 10)]
    seasons = water.evaluate(
        calibrated, weather, years, dates, 0.4, 0.9, CAP, fixed_days=fixed, rain_fraction=0.5
    )
    got = {(r.site_id, r.crop_id, r.variant, r.year, r.month, r.day): r for r in seasons.collect()}
    expected = expected_seasons(sites, dates, fixed)
    assert set(got) == set(expected) and len(got) > 20
    for key, (lengths, run) in expected.items():
        r = got[key]
        assert [r.ini, r.dev, r.mid, r.late] == lengths
        assert r.season_days == run["days"] and (r.end - r.start).days == run["days"] - 1
        assert r.etc_by_stage == pytest.approx(run["etc"])
        assert r.gross_mm == pytest.approx(run["gross"])
        assert (r.frost_days, r.heat_days) == (run["frost"], run["heat"])
        assert r.stage_temp == pytest.approx(run["temps"])
        assert r.thermal_dev == pytest.approx(run["dev"]) and r.thermal_worst == run["worst"]


def test_sweep_and_summary(setup, sites):
    weather, years, variants, calibrated = setup
    dates = water.sweep_dates(60)
    assert dates[0] == (1, 1) and len(water.sweep_dates(15)) == 25
    seasons = water.evaluate(calibrated, weather, years, dates, 0.4, 0.9, CAP, rain_fraction=0.5)
    expected = expected_seasons(sites, dates)
    table = {(r.site_id, r.crop_id, r.variant, r.month, r.day): r for r in water.planting_sweep(seasons).collect()}
    for key, r in table.items():
        runs = [run for k, (_, run) in expected.items() if (*k[:3], *k[4:]) == key]
        assert r.years == len(runs)
        assert r.gross_median == pytest.approx(statistics.median(x["gross"] for x in runs))
        assert r.days == int(statistics.median(x["days"] for x in runs))
        frosty = key[1] == "alpha" and sum(x["frost"] > 0 for x in runs) / len(runs) > 0.10
        unfit = sum(x["dev"] > 0 for x in runs) / len(runs) > 0.20
        assert r.flags == "F" * frosty + "T" * unfit
    assert table
    open_dates = water.planting_sweep(seasons, show_all=False).collect()
    assert {r.flags for r in open_dates} <= {""}
    for r in water.planting_summary(seasons).collect():
        runs = [run for k, (_, run) in expected.items() if (*k[:3], *k[4:]) == (r.site_id, r.crop_id, r.variant, r.month, r.day)]
        worst = max(x["dev"] for x in runs)
        assert (r.worst_departure is None) == (worst == 0)
        if worst:
            assert r.worst_departure == pytest.approx(worst)
        assert r.m3_15_dunum == pytest.approx(15 * statistics.median(x["gross"] for x in runs))


def stages(spark, heats, needs):
    """Stage lengths for daily heats starting on 1 January."""
    first = dt.date(2001, 1, 1)
    days = [
        ("s", first + dt.timedelta(days=i), h, h, 1.0, 0.0, None, 1.0, "era5_archive") for i, h in enumerate(heats) if h != "gap"
    ]
    weather = spark.createDataFrame(days, DDL)
    years = spark.createDataFrame([("s", 2001)], "site_id string, year int")
    candidate = spark.createDataFrame(
        [("s", 2001, "c", 0, 1, 1, [float(n) for n in needs], 0.0)],
        "site_id string, year int, crop_id string, variant int, month int, day int, requirement array<double>, base double",
    )
    row = water.stage_lengths(candidate, weather, years).first()
    return row and [row.ini, row.dev, row.mid, row.late]


def test_overshoot_is_not_carried_over(spark):
    assert stages(spark, [3.0, 4.0, 5.0, 6.0, 7.0], [5, 9, 0, 0]) == [2, 2, 0, 0]


def test_stages_without_need_take_no_day(spark):
    assert stages(spark, [3.0, 4.0, 5.0, 6.0], [0, 5, -1, 9]) == [0, 2, 0, 2]


def test_a_missing_day_fails_the_season_only_before_its_end(spark):
    assert stages(spark, [5.0, None, 5.0, 5.0, 5.0], [1, 1, 1, 1]) is None
    assert stages(spark, [5.0, "gap", 5.0, 5.0, 5.0], [1, 1, 1, 1]) is None
    assert stages(spark, [5.0, 5.0, 5.0, 5.0, None], [1, 1, 1, 1]) == [1, 1, 1, 1]


def test_four_hundred_days_at_most(spark):
    assert stages(spark, [1.0] * 500, [100, 100, 100, 100]) == [100, 100, 100, 100]
    assert stages(spark, [1.0] * 500, [100, 100, 100, 101]) is None


def test_base_sensitivity(setup, sites):
    weather, years, variants, _ = setup
    got = {(r.site_id, r.crop_id, r.variant, r.base): r for r in water.gdd_sensitivity(weather, years, variants, (BASE, 12.0), CAP).collect()}
    for s, site in sites.items():
        for crop in CROPS:
            needs = site.requirement(crop)
            if needs is None:
                continue
            middle = site.years[len(site.years) // 2]
            lengths = site.lengths(dt.date(middle, crop[6][0], 15), needs)
            row = got[s, crop[0], crop[1], BASE]
            assert row.gdd_total == pytest.approx(sum(needs))
            assert row.season_days == (sum(lengths) if lengths else 0)


def test_any_number_of_variants(spark):
    years = spark.createDataFrame([("s", 2001), ("s", 2002), ("t", 2001)], "site_id string, year int")
    variants = spark.range(10_001).select(F.lit("c").alias("crop_id"), F.col("id").cast("int").alias("variant"))
    met = water._every_variant(years, variants)
    assert met.count() == met.distinct().count() == 30_003


@pytest.mark.parametrize("length", [1, 400, 800, 1200])
def test_long_seasons_are_whole(spark, length):
    first = dt.date(2000, 1, 1)
    rows = [("s", first + dt.timedelta(days=i), 10.0, 20.0, 1.0, 0.0, 1.0, 1.0, "era5_archive") for i in range(2000)]
    weather = spark.createDataFrame(rows, DDL)
    years = spark.createDataFrame([("s", 2000)], "site_id string, year int")
    crop = ("s", 2000, "c", 0, 12, 31, 0, 0, length, 0, 0.6, 1.05, 0.9, 0.7, None)
    kc = "kc_ini double, kc_mid double, kc_end double, height double, heat_threshold double"
    ddl = "site_id string, year int, crop_id string, variant int, month int, day int, ini int, dev int, mid int, late int, "
    et0 = next(i for i, c in enumerate(weather.columns) if c == "et0")
    for longest in (None, length):
        row = water.season_run(spark.createDataFrame([crop], ddl + kc), weather, years, 1.0, 1.0, longest=longest).first()
        assert row.season_days == length and row.et0_mm == pytest.approx(length * rows[0][et0])
        assert row.end == dt.date(2000, 12, 31) + dt.timedelta(days=length - 1)


def test_stage_lengths_against_a_plain_walk(spark):
    """Missing days, null temperatures, needs met exactly, zero needs, starts off the record, a season too long."""
    first = dt.date(2019, 12, 30)
    days = {first + dt.timedelta(days=i): 10.0 + (i * 7 % 5) for i in range(900)}
    del days[dt.date(2020, 3, 10)]
    days[dt.date(2020, 6, 1)] = None
    sky = "site_id string, date date, tmin double, tmax double, et0 double, precip double, wind_mean double, wind_max double"
    weather = spark.createDataFrame([("s", d, t, t, 1.0, 0.0, None, None) for d, t in days.items()], sky).repartition(3)
    years = spark.createDataFrame([("s", 2019), ("s", 2020), ("s", 2021), ("t", 2020)], "site_id string, year int")
    needs = [[20.0, 0.0, 31.0, 5.5], [0.0, 0.0, 0.0, 0.0], [0.0, 4.0, 0.0, 1.0], [90.0, 90.0, 90.0, 90.0], [1.0, 1.0, 1.0, 4000.0]]
    starts = [(2019, 12, 29), (2019, 12, 30), (2020, 2, 29), (2020, 3, 9), (2020, 3, 11), (2020, 5, 20), (2020, 9, 1), (2021, 2, 29), (2021, 6, 1)]
    asked = [(y, m, d, i, base) for y, m, d in starts for i in range(len(needs)) for base in (8.0, 11.5)]
    rows = [("s", y, "c", i, m, d, base, needs[i], -1, -1, -1, -1) for y, m, d, i, base in asked]
    schema = "site_id string, year int, crop_id string, variant int, month int, day int, base double, requirement array<double>, ini int, dev int, mid int, late int"
    out = water.stage_lengths(spark.createDataFrame(rows, schema), weather, years, max_days=120).collect()

    def walk(start, need, base):
        now, lengths, used = start, [], 0
        for n in need:
            heat = taken = 0
            while n > 0 and (heat + 1e-9 < n or not taken):
                if used == 120 or days.get(now) is None:
                    return None
                heat, taken, used, now = heat + max(0.0, days[now] - base), taken + 1, used + 1, now + dt.timedelta(days=1)
            lengths.append(taken)
        return lengths

    expected = {}
    for y, m, d, i, base in asked:
        if (y, m, d) != (2021, 2, 29) and (found := walk(dt.date(y, m, d), needs[i], base)):
            expected[y, m, d, i, base] = found
    got = {(r.year, r.month, r.day, r.variant, r.base): [r.ini, r.dev, r.mid, r.late] for r in out}
    assert got == expected and len(out) == len(got) > 30
