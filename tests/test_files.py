"""Documents that are written as a whole, and months that are pruned before they are opened."""

import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from marketclime.operators import prices
from marketclime.sources import documents, files, sinks


def docs(spark, *pairs):
    return spark.createDataFrame(pairs, "key string, document string")


def read(spark, path):
    return {r.key: r.document for r in files.read_documents(spark, path).collect()}


def test_one_file_per_key_and_whole_writes(spark, tmp_path):
    path = str(tmp_path / "d")
    assert read(spark, path) == {}
    first = {"a": "{}", "b/ü ?": '{"x":"é"}', "..": "1"}
    files.write_documents(docs(spark, *first.items()).repartition(3), path)
    assert read(spark, path) == first
    assert len(list((tmp_path / "d" / "data").rglob("*.json"))) == 3
    files.write_documents(docs(spark, ("a", "2")), path)
    assert read(spark, path) == {"a": "2"}
    assert read(spark, f"file:{path}") == read(spark, f"file://{path}") == {"a": "2"}


@pytest.mark.parametrize("bad", [("k", None), (None, "{}"), ("a", "3")])
def test_a_failed_write_leaves_the_old_documents(spark, tmp_path, bad):
    path = str(tmp_path / "d")
    files.write_documents(docs(spark, ("a", "1"), ("b", "2")), path)
    with pytest.raises(Exception, match="document"):
        files.write_documents(docs(spark, ("a", "9"), ("c", "9"), bad), path)
    assert read(spark, path) == {"a": "1", "b": "2"}


def test_an_empty_write_and_other_modes(spark, tmp_path):
    path = str(tmp_path / "d")
    files.write_documents(docs(spark, ("a", "1")), path)
    files.write_documents(docs(spark, ("a", "1")).limit(0), path)
    assert read(spark, path) == {}
    with pytest.raises(Exception, match="overwrite"):
        docs(spark, ("a", "1")).write.format("documents").mode("append").save(path)


def test_single_keys_open_their_files_only(spark, tmp_path):
    path = str(tmp_path / "d")
    files.write_documents(docs(spark, *[(f"k{i}", str(i)) for i in range(20)]), path)
    for file in (tmp_path / "d" / "data").rglob("*.json"):
        if file.name not in ("k3.json", "k4.json"):
            file.write_bytes(b"\xff")  # no UTF-8: reading it would fail
    found = files.read_documents(spark, path).filter(F.col("key").isin("k3", "k4", "none"))
    assert sorted(r.document for r in found.collect()) == ["3", "4"]
    assert files.read_documents(spark, path).filter("key = 'k3' and key = 'k4'").count() == 0


HEADER = "date,item,unit,price_low,price_mode,price_high,quantity\n"


@pytest.fixture
def months(tmp_path):
    folder = tmp_path / "m"
    folder.mkdir()
    for n in range(1, 13):
        with gzip.open(folder / f"2020-{n:02d}.csv.gz", "wt", encoding="utf-8") as out:
            out.write("﻿" * (n % 2) + HEADER + f'2020-{n:02d}-03,"b ""q"", x",kg,1,2,3,\n2020-{n:02d}-04,c,,"1,234",2000,5000,1\n')
    (folder / "2019-12.csv").write_text("item,date,extra\n a ,2019-12-01,5\nb,bad,\n")
    (folder / "2021-01.csv").write_text("")
    (folder / "2021-02.csv").write_text(HEADER)
    (folder / "notes.txt").write_text("x")
    return str(folder)


def test_months_are_read_in_path_and_row_order(spark, months):
    rows = files.read_months(spark, months).orderBy("ordinal").collect()
    assert len(rows) == 26 and [r.month for r in rows] == sorted(r.month for r in rows)
    assert (rows[0].item, rows[0].date, rows[0].price_mode, rows[0].month) == ("a", dt.date(2019, 12, 1), None, "2019-12")
    assert (rows[1].item, rows[1].date) == ("b", None)
    assert (rows[2].item, rows[2].quantity, rows[2].order_ok, rows[2].date) == ('b "q", x', None, 1, dt.date(2020, 1, 3))
    assert (rows[3].price_low, rows[3].price_mode) == (None, 2000.0)
    assert len({r.ordinal for r in rows}) == 26


@pytest.mark.parametrize(
    "condition, wanted",
    [("month = '2020-05'", 1), ("month in ('2020-05', '2020-07', '1999-01')", 2), ("month >= '2020-11'", 4),
     ("month > '2020-03' and month <= '2020-06'", 3), ("month < '2020-01'", 1), ("item = 'c'", 15)],
)
def test_filters_on_the_month_open_those_files_only(spark, months, condition, wanted):
    found = files.read_months(spark, months).filter(condition)
    assert found.rdd.getNumPartitions() == wanted  # a task for each file that is opened
    whole = files.read_months(spark, months).collect()
    kept = spark.createDataFrame(whole, found.schema).filter(condition)
    assert sorted(found.collect(), key=str) == sorted(kept.collect(), key=str)


def test_written_months_come_back(spark, tmp_path, rows):
    listed = rows((1, "2020-01-31", "b", 1, 2, 3, 4), (2, "2020-01-31", "a", 3, 2, 1, None), (3, "2020-02-01", "a", None, 2, 3, 4))
    sinks.write_month_files(listed, str(tmp_path / "m"))
    got = files.read_months(spark, str(tmp_path / "m")).collect()
    assert sorted((r.month, r.item, r.price_low, r.order_ok) for r in got if r.price_low) == [("2020-01", "a", 3.0, 0), ("2020-01", "b", 1.0, 1)]
    assert len(got) == 3


def test_latest_document_goes_by_first_listing(spark, rows):
    listed = rows(
        (0, "2020-01-01", "z", 1, 2, 3, 1), (1, "2020-01-01", "y", 1, 2, 3, 1), (2, "2020-01-02", "a", 1, 2, 3, 5),
        (3, "2020-01-02", "y", 1, 4, 5, 5), (4, "2020-01-02", "z", 1, 3, 5, 5), (5, "2020-01-02", "b", 1, 2.26, 3, None),
    ).withColumn("usable", F.lit(1))
    crops = spark.createDataFrame([("a", "apple")], "item string, crop_id string")
    table = documents.latest_table(listed, crops)
    one = json.loads(documents.documents(table, F.lit("latest")).first().document)
    assert (one["date"], one["previous"]) == ("2020-01-02", "2020-01-01")
    assert [(i["item"], i["crop"], i["mode"], i["change_pct"]) for i in one["items"]] == [
        ("z", None, 3.0, 50.0), ("y", None, 4.0, 100.0), ("a", "apple", 2.0, None), ("b", None, 2.3, None),
    ]
    assert documents.latest_table(listed.limit(0), crops).count() == 0


def test_series_and_weather_documents_hold_their_tables(spark, rows):
    listed = rows(*[(i, str(dt.date(2020, 1, 1) + dt.timedelta(days=i)), "a", 1, 2.0 + i % 3, 9, i % 4) for i in range(160)])
    listed = listed.withColumn("usable", F.lit(1))
    crops = spark.createDataFrame([], "item string, crop_id string")
    table = documents.series_table(listed, crops)
    one = json.loads(documents.documents(table, "series_id").first().document)
    assert one["series_id"] == "s000" and one["members"] == ["a"] and one["days"] == 160 and one["crop"] is None
    weekly = prices.weekly_prices(listed).orderBy("week").collect()
    assert [w["week"] for w in one["weekly"]] == [r.week for r in weekly] and one["weekly"][3]["n"] == 7
    assert documents.parsed(documents.documents(table, "series_id"), table).collect() == table.collect()

    days = [(1, dt.date(2020, 10, 1) + dt.timedelta(days=i), 20.0, 5.0, None if i % 2 else 1.0, 2.0) for i in range(800)]
    weather = spark.createDataFrame(days, "site_id long, date date, tmax double, tmin double, precip double, et0 double")
    weather = weather.withColumn("source", F.lit("era5_archive")).withColumn("wind_max", F.lit(1.0))
    one = documents.weather_table(weather).first()
    assert one.complete_years == [2021] and len(one.daily) == 800 and len(one.monthly) == 12
    # days without rain data count as dry
    assert [(s.season, s.rain_mm) for s in one.seasonal_rain] == [(2020, 183.0), (2021, 182.0)]
    profile = documents.climate_table(weather, (0.0,), (3, 1), 10.0).first()
    assert profile.complete_years == [2021] and profile.gdd.start == "03-01" and profile.gdd.days_to_target[0].target == 400.0
