import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from marketclime.operators import quality
from marketclime.sources import pages, prices, reference, sinks, state, tables, weather

HEADER = "date,item,unit,price_low,price_mode,price_high,quantity"


def write(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding)
    return str(path)


def test_raw_prices_coerce_cell_by_cell(spark, tmp_path):
    path = write(
        tmp_path / "raw.csv",
        HEADER + ',kind,order_ok,source_file\n2015-8-1, a  ,kg,1,2,3,,local,1,x\nbad,"b ""q""",kg,x,"1,234",3,0,local,,x\n',
        "utf-8-sig",
    )
    one, two = prices.read_raw_prices(spark, path).orderBy("ordinal").collect()
    assert (one.date, one.item, one.price_mode, one.quantity, one.order_ok) == (dt.date(2015, 8, 1), "a", 2.0, None, 1)
    assert (two.date, two.item, two.price_low, two.price_mode, two.quantity, two.order_ok) == (None, 'b "q"', None, None, 0.0, None)


def test_clean_prices_keep_usable_rows(spark, tmp_path):
    path = write(
        tmp_path / "clean.csv",
        "date,item,item_raw,unit,price_low,price_mode,price_high,quantity,order_ok,outlier,duplicate,usable\n"
        "2020-01-01,a,a,kg,1,2,3,4,1,0,0,1\n2020-01-01,b,b,kg,1,2,3,4,1,1,0,0\n2020-01-01,c,c,kg,1,,3,4,1,0,0,1\nx,d,d,kg,1,2,3,4,1,0,0,1\n",
    )
    assert [r.item for r in prices.read_clean_prices(spark, path).collect()] == ["a"]


def test_ordinals_follow_paths_and_rows_whatever_the_split(spark, tmp_path):
    """The largest file comes last by path, and files are cut into several parts."""
    for name, n in (("a 1", 3), ("b%20", 900), ("c", 5000)):
        lines = [f"2020-01-01,{name}-{i},kg,1,2,3,4" for i in range(n)]
        write(tmp_path / f"{name}.csv", "\n".join([HEADER, *lines]) + "\n")
    expected = [f"{name}-{i}" for name, n in (("a 1", 3), ("b%20", 900), ("c", 5000)) for i in range(n)]
    settings = {"spark.sql.files.maxPartitionBytes": "9000", "spark.sql.files.openCostInBytes": "10"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df = prices.read_month_files(spark, str(tmp_path))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
        assert df.select(F.spark_partition_id()).distinct().count() > 10
        got = df.select("item", "ordinal").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [r.item for r in sorted(got, key=lambda r: r.ordinal)] == expected
    assert len({r.ordinal for r in got}) == len(expected)


def test_the_last_file_by_path_wins(spark, tmp_path):
    for name, crop in (("1", "old"), ("2", "new")):
        write(tmp_path / f"{name}.csv", "item,crop_id,notes\n" + f"a,{crop},\n" + "".join(f"{name}x{i},c,\n" for i in range(20 if name == "1" else 2)))
    assert {r.item: r.crop_id for r in reference.read_mapping(spark, str(tmp_path)).collect()}["a"] == "new"


def test_month_files_round_trip(spark, tmp_path, rows):
    df = rows(
        (1, "2020-01-31", "b", 1, 2, 3, 4), (2, "2020-01-31", "a", 3, 2, 1, None), (3, "2020-02-01", "a", None, 2, 3, 4)
    )
    sinks.write_month_files(df, str(tmp_path / "m"))
    files = sorted(tmp_path.glob("m/month=*/*.csv.gz"))
    assert {f.parent.name for f in files} == {"month=2020-01", "month=2020-02"}
    with gzip.open(files[0], "rt") as fh:
        assert fh.read().splitlines()[0] == HEADER
    back = prices.read_month_files(spark, str(tmp_path / "m" / "*")).collect()
    assert sorted((r.date, r.item, r.price_low, r.quantity, r.order_ok) for r in back if r.price_low) == [
        (dt.date(2020, 1, 31), "a", 3.0, None, 0),
        (dt.date(2020, 1, 31), "b", 1.0, 4.0, 1),
    ]
    assert len(back) == 3


def test_only_the_months_at_hand_are_rewritten(spark, tmp_path, rows):
    store = str(tmp_path / "store")
    sinks.write_month_store(rows((1, "2020-01-31", "a", 1, 2, 3, 4), (2, "2020-02-01", "a", 1, 2, 3, 4)), store)
    sinks.rewrite_months(rows((3, "2020-02-02", "z", 1, 2, 3, 4)), store)
    assert sorted((str(r.date), r.item) for r in spark.read.parquet(store).collect()) == [("2020-01-31", "a"), ("2020-02-02", "z")]
    one = prices.read_month_store(spark, store, ["2020-01"])
    assert one.count() == 1
    assert "PartitionFilters: [isnotnull(month" in one._jdf.queryExecution().toString()


def test_row_positions_follow_files_and_rows(spark, tmp_path):
    path = str(tmp_path / "t t")
    for name, first in (("b", 0), ("a", 100)):
        spark.range(first, first + 50).coalesce(1).write.mode("append").parquet(f"{path}/{name}")
    df = spark.read.option("recursiveFileLookup", True).parquet(path)
    got = [r.id for r in tables.with_ordinal(df).orderBy("ordinal").collect()]
    assert got == [*range(100, 150), *range(50)]
    single = spark.read.parquet(f"{path}/a")
    assert [r.ordinal for r in tables.with_ordinal(single).orderBy("id").collect()] == list(range(50))


# ------------------------------------------------------------------- pages


def bulletin(*lines, table="<table class='x table-bordered'>", header="<tr><th>h</th></tr>"):
    return f"<html><body>{table}{header}{''.join(lines)}</table></body></html>"


def line(item, day="05-08-2015", *, unit="kg", high="٣", mode="2", low="1", qty="1,500", tag="td"):
    cells = "".join(f"<{tag}> <b>{c}</b> </{tag}>" for c in (item, unit, high, mode, low, qty, day))
    return f"<tr>{cells}</tr>"


PAGES = {
    "raw/2015/2015-08-05.html": bulletin(line("a"), line("‏b‏ &amp; c"), line("d", ""), "<tr><td>short</td></tr>", line("")),
    "raw/2015/2015-08-06.html": "<html><table class='other'><tr><td>x</td></tr></table></html>",
    "raw/2015/2015-08-07.html": bulletin(),
    "raw/2015/2015-08-08.html": bulletin(line("e", "2015-8-8"), line("f", "9/8/2015"), line("g", "soon")),
    "raw/2015/2015-08-09.html": "<!-- <table class='table-bordered'><tr></tr> -->" + bulletin(line("k&eacute;"), "<tr><td>m<td>kg<td>3<td>2<td>1<td>9<td>09-08-2015"),
    "raw/2015/2015-08-10.html": bulletin(line("n<script>var x='</td>'</script>"), table="<TABLE CLASS=table-bordered>"),
    "raw/2015/2015-08-11.html": bulletin(line("o"), table="<table class='table-bordered-not'>"),
    "raw/2015/2015-08-12.html": bulletin(line("p"), table='<table id="t" class="a table-bordered b">', header=""),
}


@pytest.fixture
def saved(spark):
    return spark.createDataFrame(list(PAGES.items()), "path string, html string")


def test_bulletin_rows(saved):
    got = {(r.source_file[:10], r.item): r for r in pages.bulletin_rows(saved).collect()}
    first = got["2015-08-05", "a"]
    assert (first.price_low, first.price_mode, first.price_high, first.quantity, first.order_ok) == (1.0, 2.0, 3.0, 1500.0, 1)
    assert first.date == dt.date(2015, 8, 5) and first.kind == "local"
    assert ("2015-08-05", "b & c") in got  # marks inside the cell are gone
    assert got["2015-08-05", "d"].date == dt.date(2015, 8, 5)  # from the file name
    assert [got["2015-08-08", i].date.day for i in "efg"] == [8, 9, 8]
    assert got["2015-08-09", "ké"].price_mode == 2.0 and got["2015-08-09", "m"].quantity == 9.0
    assert ("2015-08-10", "n") in got
    # the first row is taken as the header, whatever it holds; another class is another table
    assert not [k for k in got if k[0] in ("2015-08-11", "2015-08-12", "2015-08-06", "2015-08-07")]
    assert len(got) == 9


def test_tidy_and_messy_pages_give_the_same_rows(spark, saved):
    """A trailing comment sends the page through the HTML parser."""
    tidy = [k for k in PAGES if "08-09" not in k and "08-10" not in k]
    plain = saved.filter(F.col("path").isin(*tidy))
    messy = plain.withColumn("html", F.concat("html", F.lit("<!-- x -->")))
    a, b = (sorted((r.path, r.rows) for r in pages.table_rows(df).select("path", "rows").collect()) for df in (plain, messy))
    assert a == b and sum(len(r) for _, r in a) == 6


def test_a_page_for_another_day_is_refused_whole(spark):
    day = dt.date(2015, 8, 5)
    data = [
        ("good", bulletin(line("a"), line("b", "")), day),
        ("bad", bulletin(line("a"), line("b", "04-08-2015")), day),
        ("none", "<p>", day),
        ("iso", bulletin(line("a", "2015-08-05")), day),  # only the served form counts
    ]
    df = spark.createDataFrame(data, "path string, html string, expected date")
    got = pages.requested_rows(df).collect()
    assert sorted((r.path, r.item, r.date) for r in got) == [("good", "a", day), ("good", "b", day)]
    counts = {r.path: r.row_count for r in pages.page_counts(df).collect()}
    assert counts == {"good": 2, "bad": 2, "none": 0, "iso": 1}


def test_saved_pages_are_read_whole(spark, tmp_path):
    (tmp_path / "2015").mkdir()
    write(tmp_path / "2015" / "2015-08-05.html", bulletin(line("a"), "\n", line("b")))
    write(tmp_path / "2015" / "note.txt", "x")
    got = pages.bulletin_rows(pages.read_pages(spark, str(tmp_path)))
    assert sorted((r.item, r.row, r.source_file) for r in got.collect()) == [("a", 0, "2015-08-05.html"), ("b", 1, "2015-08-05.html")]


# ------------------------------------------------------------------- weather, parameters, state


def test_weather_csv(spark, tmp_path):
    path = write(
        tmp_path / "w.csv",
        "date,temperature_2m_max,temperature_2m_min,precipitation_sum,et0_fao_evapotranspiration,wind_speed_10m_max,source\n"
        "2020-01-02,10,1,None,2.5,9,era5_archive\n2020-01-01,9,,0,2,9,era5_archive\n2020-01-02,11,1,,2.5,9,preliminary\n",
    )
    got = {r.date.day: r for r in weather.read_weather(spark, path).collect()}
    assert (got[1].tmin, got[1].precip, got[1].wind_mean, got[1].site_id) == (None, 0.0, None, "site")
    assert (got[2].tmax, got[2].precip, got[2].source) == (11.0, None, "preliminary")  # the last row wins


def test_payload(spark):
    df = spark.createDataFrame(
        [(1, (["2020-01-01", "2020-01-02", "2020-01-03"], [1.0, 2.0, 3.0], [5.0]))],
        "id int, daily struct<time: array<string>, temperature_2m_max: array<double>, precipitation_sum: array<double>>",
    )
    got = weather.payload_rows(df, keep=["id"]).orderBy("date").collect()
    assert [(r.temperature_2m_max, r.precipitation_sum, r.rain_sum) for r in got] == [(1.0, 5.0, None), (2.0, None, None), (3.0, None, None)]
    flat = spark.createDataFrame([([1, 2], [9])], "a array<int>, b array<int>")
    assert [tuple(r) for r in weather.zipped_rows(flat, ["a", "b"]).collect()] == [(1, 9), (2, None)]


def test_crops(spark, tmp_path):
    def crop(name, mid, stages, **more):
        sourced = {"value": mid, "src": "t"}
        return {"id": name, "name_en": name, "kc": {"ini": {"value": 0.6}, "mid": sourced, "end": {"value": 0.9}}, "height_m": {"value": 0.7}, "stage_lengths_days": stages, **more}

    stage = {"ini": 25, "dev": 35, "mid": 40, "late": 20, "total": 125, "plant_date": "April/June", "region": "r", "src": "t"}
    document = {
        "_meta": {"x": 1},
        "crops": [
            crop("full", 1.05, [stage, {**stage, "plant_date": "Oct"}], frost_tolerant=True, heat_threshold_c=35),
            crop("bare", None, [], GAP="nothing published about this one, so it is left blank"),
            crop("half", None, [stage]),
        ],
    }
    path = write(tmp_path / "crops.json", json.dumps(document, indent=1))
    crops = reference.read_crops(spark, path)
    listing = {r.id: (r.variants, r.frost, r.status) for r in reference.crop_listing(crops).collect()}
    assert listing["full"] == (2, "tolerant", "ready")
    assert listing["bare"] == (0, "sensitive", "INCOMPLETE: nothing published about this one, so it is left blank")
    assert listing["half"] == (1, "sensitive", "INCOMPLETE: ")
    variants = reference.crop_variants(crops).orderBy("variant").collect()
    assert [(r.crop_id, r.variant, r.months, r.ini + r.dev + r.mid + r.late) for r in variants] == [
        ("full", 0, [4, 6], 120),  # the parts, not the printed total
        ("full", 1, [10], 120),
    ]
    assert variants[0].heat_threshold == 35.0 and variants[0].frost_tolerant


def test_mapping_and_merges(spark, tmp_path):
    path = write(tmp_path / "m.csv", "item,crop_id,notes\na, eggplant ,n\nb,ignore,\nc,,x\na,melon,later\nd,melon,\n ,melon,\n", "utf-8-sig")
    mapping = reference.read_mapping(spark, path)
    assert sorted(tuple(r) for r in mapping.collect()) == [("a", "melon", "later"), ("b", "ignore", ""), ("c", "", "x"), ("d", "melon", "")]
    assert sorted(tuple(r) for r in reference.crop_tags(mapping).collect()) == [("a", "melon"), ("d", "melon")]
    assert reference.crop_members(mapping).first().members == ["a", "d"]
    merges = reference.read_merges(spark, write(tmp_path / "x.csv", "from_item,to_item\n a ,b\na,c\n"))
    assert [tuple(r) for r in merges.collect()] == [("a", "c")]


def test_yield_csv(spark, tmp_path):
    path = write(tmp_path / "y.csv", "Item Code (FAO),Year,Unit,Value\n399,2001, hg/ha ,100\n399,x,hg/ha,1\n401,2002,kg/ha,\n")
    assert [tuple(r) for r in reference.read_yields(spark, path).collect()] == [("399", 2001, 100.0, "hg/ha")]


def test_checkpoint_and_state(spark, tmp_path):
    entries = {
        "2020-01-01": {"status": "ok", "at": "t", "rows": 5},
        "2020-01-02": {"status": "empty", "at": "t"},
        "2020-01-04": {"status": "empty_confirmed", "at": "t", "note": "n"},
    }
    checkpoint = state.read_checkpoint(spark, write(tmp_path / "c.json", json.dumps(entries, indent=1)))
    counts = {r.status: r.days for r in state.status_counts(checkpoint).collect()}
    assert counts == {"ok": 1, "empty_unverified": 1, "empty_confirmed": 1}
    assert [r.date for r in state.confirmed_empty(checkpoint).collect()] == [dt.date(2020, 1, 4)]
    doc = {"first": "2015-08-01", "last": "2026-08-06", "days_with_data": 2, "no_bulletin": ["2015-08-23"], "last_run": "t"}
    row = state.read_state(spark, write(tmp_path / "s.json", json.dumps(doc, indent=1))).first()
    assert (row.first, row.days_with_data, row.no_bulletin) == (dt.date(2015, 8, 1), 2, [dt.date(2015, 8, 23)])


def test_writers(spark, tmp_path, rows):
    clean = quality.clean_prices(rows((1, "2020-01-01", "a", 1, 2, 3, 4), (2, "2020-01-01", "a", 1, 2, 3, 4)))
    sinks.write_flagged(clean, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 2
    payload = spark.createDataFrame([("s000", [1]), ("s003", [2])], "series_id string, weekly array<int>")
    sinks.write_series(payload, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p" / "series_id=s003")).first().weekly == [2]
    pairs = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.0)], "item_a string, item_b string, cooccurrence_rate double")
    sinks.write_review(pairs, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 2
