import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from marketclime.functions import agronomy, calendar, numbers, text


def one(spark, column, **values):
    ddl = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items())
    df = spark.createDataFrame([tuple(values.values())], ddl) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "raw, value",
    [
        ("١٢٫٥".replace("٫", "."), 12.5),
        ("‏1,234.50‎", 1234.5),
        (" 7 ", 7.0),
        ("", None),
        ("n/a", None),
        ("nan", None),
        ("inf", None),
        ("1d", None),
        ("0x10", None),
        ("1e3", 1000.0),
        (".5", 0.5),
        ("-3", -3.0),
    ],
)
def test_published_numbers(spark, raw, value):
    assert one(spark, text.to_number(F.col("v")), v=raw) == value


def test_thousands_separators_only_in_published_cells(spark):
    assert one(spark, text.plain_number(F.col("v")), v="1,234") is None


@pytest.mark.parametrize(
    "raw, day",
    [
        ("05-08-2015", dt.date(2015, 8, 5)),
        ("2015-8-1", dt.date(2015, 8, 1)),
        ("٥/٨/٢٠١٥", dt.date(2015, 8, 5)),
        ("31-02-2015", None),
        ("", None),
        ("soon", None),
    ],
)
def test_dates_in_any_form(spark, raw, day):
    assert one(spark, text.to_date_any(F.col("v")), v=raw) == day


def test_strip_knows_unicode_blanks(spark):
    assert one(spark, text.strip(F.col("v")), v="  \tx y \u001f") == "x y"


def test_arabic_folds(spark):
    names = {
        "بندورة": "بندوره",
        "أحمر": "احمر",
        "كمــه": "كمه",
        "فلفـل  حلوى": "فلفل حلوي",
        "مُشَكَّل": "مشكل",
        "ﻻ": "لا",  # presentation form, NFKC
        "مؤونة ئ": "موونه ي",
    }
    df = spark.createDataFrame([(k,) for k in names], "item string")
    got = df.select("item", text.fold_arabic(text.nfkc()("item")).alias("n")).collect()
    assert {r.item: r.n for r in got} == names


@pytest.mark.parametrize(
    "raw, months",
    [("Oct/Nov", [10, 11]), ("April; December", [4, 12]), ("May, may/June", [5, 6]), ("sometime", []), ("", [])],
)
def test_planting_months(spark, raw, months):
    assert one(spark, text.month_numbers(F.col("v")), v=raw) == months


@pytest.mark.parametrize(
    "unit, kg", [("hg/ha", 100.0), ("100 g/ha", 100.0), ("kg/ha", 1000.0), ("T / HA", 1e6), ("tonnes/ha", 1e6), ("bu", None)]
)
def test_yield_units(spark, unit, kg):
    got = one(spark, text.kg_per_dunum(F.lit(10000.0), F.col("u")), u=unit)
    assert got is None if kg is None else got == pytest.approx(kg)


def test_weeks_start_on_saturday(spark):
    df = spark.createDataFrame([("2026-08-06",), ("2026-08-01",), ("2026-07-31",), ("1969-12-26",)], "d string")
    day = F.col("d").cast("date")
    got = [tuple(r) for r in df.select(calendar.week_key(day), calendar.week_start(calendar.week_key(day))).collect()]
    assert got[0] == (2953, dt.date(2026, 8, 1)) == got[1]
    assert got[2][1] == dt.date(2026, 7, 25)
    assert got[3][1] == dt.date(1969, 12, 20)


def test_week_of_year_comes_from_the_week_start(spark):
    df = spark.createDataFrame([("2021-01-01",), ("2021-01-02",), ("2016-12-31",)], "d string")
    got = [r[0] for r in df.select(calendar.week_of_year(F.col("d").cast("date"))).collect()]
    assert got == [51, 0, 52]


def test_calendar_labels(spark):
    assert one(spark, calendar.day_label(F.lit(60.0))) == "01 Mar"
    assert one(spark, calendar.day_label(F.lit(2.5))) == "02 Jan"  # halves to even
    assert one(spark, calendar.date_of(F.lit(2001), F.lit(2), F.lit(29))) is None
    assert one(spark, calendar.date_of(F.lit(2004), F.lit(2), F.lit(29))) == dt.date(2004, 2, 29)
    assert one(spark, calendar.hydro_year(F.lit("2001-09-30").cast("date"))) == 2000
    assert one(spark, calendar.hydro_year(F.lit("2001-10-01").cast("date"))) == 2001


def test_percent_change(spark):
    assert one(spark, numbers.percent_change(F.lit(12.0), F.lit(10.0))) == pytest.approx(20.0)
    assert one(spark, numbers.percent_change(F.lit(12.0), F.lit(0.0))) is None
    assert one(spark, numbers.percent_change(F.lit(12.0), F.lit(None).cast("double"))) is None


def test_order_buckets_never_decrease(spark):
    rng = random.Random(5)
    values = [0.0, -0.0, 1.0, 2.0, -1.0, 1e-310, 1e305, -1e305, math.nextafter(2.0, 0), math.nextafter(4.0, 9)]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 12) for _ in range(500)]
    values += [2.0**e for e in range(-60, 60)] + [math.nextafter(2.0**e, 0) for e in range(-60, 60)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    pairs = sorted((r.v, r.b) for r in df.select("v", numbers.order_bucket(F.col("v")).alias("b")).collect())
    assert all(b1 <= b2 for (_, b1), (_, b2) in zip(pairs, pairs[1:]))


def test_fao_terms(spark):
    assert one(spark, agronomy.saturation_vapour_pressure(F.lit(25.0))) == pytest.approx(3.168, abs=2e-3)
    assert one(spark, agronomy.wind_at_2m(F.lit(36.0))) == pytest.approx(10 * 4.87 / math.log(672.58))
    assert one(spark, agronomy.rh_min(F.lit(10.0), F.lit(30.0))) == pytest.approx(
        100 * math.exp(17.27 * 8 / 245.3) / math.exp(17.27 * 30 / 267.3)
    )
    # standard climate leaves the tabulated value alone
    kc = agronomy.adjust_kc(F.lit(1.05), F.lit(2.0), F.lit(45.0), F.lit(0.7))
    assert one(spark, kc) == pytest.approx(1.05)
    clamped = agronomy.adjust_kc(F.lit(1.0), F.lit(9.0), F.lit(5.0), F.lit(3.0))
    assert one(spark, clamped) == pytest.approx(1.0 + 0.04 * 4 + 0.004 * 25)
    unknown = agronomy.adjust_kc(F.lit(1.0), F.lit(None).cast("double"), F.lit(5.0), F.lit(3.0))
    assert one(spark, unknown) == 1.0


def test_kc_curve_at_its_corners(spark):
    days = spark.range(1, 101)
    stages = [F.lit(n) for n in (20, 30, 30, 20)]
    curve = agronomy.kc_on_day(F.col("id"), *stages, F.lit(0.2), F.lit(1.0), F.lit(0.6))
    got = [r[0] for r in days.select(curve).collect()]
    assert got[0] == got[19] == pytest.approx(0.2)
    assert got[49] == pytest.approx(1.0) == got[79]
    assert got[34] == pytest.approx(0.2 + 15 / 30 * 0.8)
    assert got[99] == pytest.approx(0.6)
    # a stage without days does not divide by zero
    none = agronomy.kc_on_day(F.lit(5), F.lit(5), F.lit(0), F.lit(0), F.lit(0), F.lit(0.2), F.lit(1.0), F.lit(0.6))
    assert one(spark, none) == pytest.approx(0.2)


def test_degree_days(spark):
    null = F.lit(None).cast("double")
    assert one(spark, agronomy.degree_days(F.lit(10.0), F.lit(40.0), 10.0, 30.0)) == pytest.approx(10.0)
    assert one(spark, agronomy.degree_days(F.lit(-5.0), F.lit(5.0), 10.0)) == 0.0
    assert one(spark, agronomy.degree_days(null, F.lit(40.0), 10.0, 30.0)) is None
    assert one(spark, agronomy.clamp(null, 1, 6)) is None
