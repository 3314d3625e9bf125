import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketclime.operators import prices, profiles
from marketclime.sources.sinks import series_payload, snapshot_payload


def usable(df):
    return df.withColumn("usable", F.lit(1))


@pytest.fixture
def no_mapping(spark):
    return spark.createDataFrame([], "item string, crop_id string")


def test_weekly_medians(rows):
    df = rows(
        (1, "2026-08-01", "a", 1, 2, 3, 5),
        (2, "2026-08-06", "a", 1, 4, 5, 0),
        (3, "2026-08-07", "a", None, 6, 9, None),
        (4, "2026-08-08", "a", 2, 8, 9, 1),
    )
    got = {str(r.week_start): r for r in prices.weekly_prices(usable(df)).collect()}
    first = got["2026-08-01"]
    # a row without low gives no high either; a quantity of zero is no quantity
    assert (first.mode, first.low, first.high, first.qty_t, first.n) == (4.0, 1.0, 4.0, 5.0, 3)
    assert got["2026-08-08"].n == 1


def test_season_needs_four_observations(rows):
    data = [(i, f"20{10 + i}-05-15", "a", 1, float(i), 9, 1) for i in range(4)] + [(9, "2015-11-15", "a", 1, 5.0, 9, 1)]
    got = prices.seasonal_profile(usable(rows(*data))).collect()
    assert sum(r.n for r in got if r.n >= 4) == sum(r.n for r in got)


def test_series_ids_count_before_the_length_filter(rows, spark):
    data = [(i, f"2020-01-0{1 + i % 2}", "busy", 1, 2.0, 3, 1) for i in range(9)]
    data += [(20 + i, f"2020-02-{1 + i:02d}", "long", 1, 2.0, 3, 1) for i in range(5)]
    data += [(10 + i, f"2020-02-{1 + i:02d}", "early", 1, 2.0, 3, 1) for i in range(5)]
    mapping = spark.createDataFrame([("early", "c")], "item string, crop_id string")
    got = {r.item: r for r in prices.series_index(usable(rows(*data)), mapping, min_days=3).collect()}
    assert {k: r.series_id for k, r in got.items()} == {"early": "s001", "long": "s002"}
    assert got["early"].mapped and not got["long"].mapped


def test_snapshot_compares_with_the_previous_market_day(rows, no_mapping):
    df = rows(
        (1, "2021-05-01", "a", 1, 10, 11, 5),
        (2, "2021-05-02", "b", 1, 7, 8, 5),  # the market was open, a was not listed
        (5, "2021-05-03", "a", 1, 12, 13, 0),
        (4, "2021-05-03", "a", 1, 14, 15, 9),  # listed first
        (6, "2021-05-03", "b", 1, 14, 15, 2),
        (7, "2020-05-04", "a", 1, 1, 15, 2),
        (8, "2019-05-04", "a", 1, 2, 15, 2),
        (9, "2018-05-06", "a", 1, 3, 15, 2),
    )
    got = {r.item: r for r in prices.latest_snapshot(usable(df), no_mapping).collect()}
    assert got["a"].mode == 14 and got["a"].prev_mode is None and got["a"].change_pct is None
    assert got["b"].prev_mode == 7 and got["b"].change_pct == pytest.approx(100.0)
    # history: same week of year on any other day; both rows of the latest day are out
    assert got["a"].week_n == 4 and got["a"].week_median == 2.5
    assert got["b"].week_n == 1 and got["b"].week_median is None
    assert [r.item for r in snapshot_payload(prices.latest_snapshot(usable(df), no_mapping)).collect()] == ["a", "b"]


def test_snapshot_of_a_single_day(rows, no_mapping):
    df = rows((1, "2021-05-01", "a", 1, 10, 11, 5))
    got = prices.latest_snapshot(usable(df), no_mapping).first()
    assert (got.mode, got.prev_mode, got.week_n) == (10, None, 0)


def test_payload_nests_the_tables(rows, no_mapping):
    data = [(i, str(dt.date(2020, 1, 4) + dt.timedelta(days=7 * i)), "a", 1, 2.0 + i, 30, 1) for i in range(6)]
    df = usable(rows(*data))
    index = prices.series_index(df, no_mapping, min_days=2)
    payload = series_payload(index, prices.weekly_prices(df), prices.seasonal_profile(df, 1)).first()
    assert payload.name == "a" and payload.members == ["a"]
    assert [w.mode for w in payload.weekly] == [2.0, 3.0, 4.0, 5.0, 6.0, 7.0]
    assert len(payload.seasonal) == 6


def test_item_profile(spark, rows):
    data, ordinal = [], 0
    for month, price in ((1, 5.0), (2, 9.0), (3, 9.0), (4, 5.0), (5, 6.0), (6, 7.0)):
        for day in range(1, 6):
            data.append((ordinal, f"2020-{month:02d}-{day:02d}", "a", 1, price, 99, 0.0))
            ordinal += 1
    data.append((ordinal, "2020-07-01", "a", 99, 50.0, 1, 8.0))  # out of order: seen, not counted
    data.append((ordinal + 1, "2020-07-01", "thin", 1, 3.0, 9, None))
    data.append((ordinal + 2, None, "undated", 1, 3.0, 9, None))
    existing = spark.createDataFrame([("a", "crop", "note")], "item string, crop_id string, notes string")
    got = {r.item: r for r in profiles.item_profile(rows(*data), existing).collect()}
    assert set(got) == {"a", "thin"}
    a = got["a"]
    assert (a.days_seen, a.flagged, a.crop_id, a.notes, a.span) == (31, 1, "crop", "note", "2020-2020")
    assert a.median_mode_price == 6.5 and a.median_qty_t == 0.0  # zero quantity counts here
    assert (a.peak_month, a.trough_month) == ("Feb", "Jan")  # ties: the month met first
    assert got["thin"].peak_month is None and got["thin"].median_qty_t is None
    coverage = profiles.mapping_coverage(rows(*data), existing).first()
    assert (coverage.distinct_items, coverage["items"], coverage.mapped, coverage.thin_items) == (3, 2, 1, 2)


def test_parse_report(rows, spark):
    df = rows(
        (1, "2020-01-01", "a", 1, 2, 3, 5),
        (2, "2021-01-01", "b", 5, 2, 3, 5),
        (3, "2021-01-01", "a", None, 2, 3, 5),
    )
    pages = spark.createDataFrame([("p", 0), ("q", 3)], "path string, row_count int")
    got = profiles.parse_summary(df, pages).first()
    assert (got.rows, got.days, got["items"], got.order_failures, got.missing_price) == (3, 2, 2, 1, 1)
    assert (got.pages, got.empty_pages) == (2, 1)
    by_year = sorted(tuple(r) for r in profiles.order_failures_by_year(df).collect())
    assert by_year == [(2020, 0, 1), (2021, 1, 2)]
    assert [tuple(r) for r in profiles.frequent_items(df, 1).collect()] == [("a", 2)]


def test_equal_counts_go_by_first_listing(rows):
    df = rows((1, None, "z", 1, 2, 3, 5), (2, "2020-01-01", "a", 1, 2, 3, 5), (3, "2020-01-01", "z", 5, 2, 3, 5))
    assert [r.item for r in profiles.top_items(profiles.item_profile(df), 1).collect()] == ["z"]
    even = df.filter("ordinal > 1").withColumn("ordinal", -df.ordinal)
    assert [tuple(r) for r in profiles.frequent_items(even, 1).collect()] == [("z", 1)]
    assert profiles.mapping_coverage(df, df.select("item", df.item.alias("crop_id")).limit(0)).first().rows_read == 3
