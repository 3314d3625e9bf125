import datetime as dt
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketclime.operators import quality
from marketclime.operators.numbering import number_rows
from marketclime.operators.quantiles import exact_mad, exact_quantiles


def table(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_first_listing_wins_whatever_the_row_order(spark, rows):
    df = rows(
        (3, "2020-01-01", "a", 1, 2, 3, 5),
        (1, "2020-01-01", "a", 1, 9, 10, 5),
        (2, "2020-01-01", "b", 1, 2, 3, 5),
        (4, None, "a", 1, 2, 3, 5),
        (5, None, "a", 1, 2, 3, 5),
    )
    flags = table(quality.flag_duplicates(df.orderBy(F.rand(1))), "ordinal", "duplicate")
    assert flags == [(1, 0), (2, 0), (3, 1), (4, 0), (5, 1)]
    assert table(quality.first_row_distinct(df), "ordinal") == [(1,), (2,), (4,)]


def test_duplicate_audit_tells_repeats_from_conflicts(rows):
    df = rows(
        (1, "2020-01-01", "a", None, 2, 3, 5),
        (2, "2020-01-01", "a", None, 2, 3, 5),
        (3, "2020-01-01", "b", 1, 2, 3, 5),
        (4, "2020-01-01", "b", 1, 2, 3, 6),
        (5, "2020-01-01", "b", 1, 2, 3, 6),
        (6, "2020-01-02", "b", 1, 2, 3, 6),
    )
    assert tuple(quality.duplicate_audit(df).first()) == (2, 3, 1, 1)
    assert quality.conflicting_examples(df).isEmpty()  # a quantity alone is no conflict


def test_conflicting_examples_list_every_row_of_a_key(rows):
    df = rows(
        (1, "2020-01-02", "a", 1, 2, 3, 5),
        (2, "2020-01-01", "b", 1, 2, 3, 5),
        (3, "2020-01-02", "a", 1, 2, 4, 5),
        (4, "2020-01-01", "b", 1, 1, 3, 5),
    )
    assert sorted(r.ordinal for r in quality.conflicting_examples(df).collect()) == [1, 2, 3, 4]
    assert sorted(r.ordinal for r in quality.conflicting_examples(df, 1).collect()) == [1, 3]


def test_ordinals_that_repeat_between_loads_multiply_nothing(rows):
    df = rows(*[(o, f"2020-01-0{d}", "a", 1, 2, 3, 5) for d in (1, 2, 3) for o in (0, 1)])
    assert sorted(r.duplicate for r in quality.flag_duplicates(df).collect()) == [0, 0, 0, 1, 1, 1]
    assert {r.ordinal for r in quality.first_row_distinct(df).collect()} == {0}
    assert quality.first_row_distinct(df).count() == 3


def test_audits_of_nothing(rows):
    df = rows((1, "2020-01-01", "a", None, None, None, None))
    assert tuple(quality.duplicate_audit(df).first()) == (0, 0, 0, 0)
    assert {r.largest for r in quality.column_order_audit(df).collect()} == {None}


def test_column_order_audit(rows):
    df = rows(
        (1, "2020-01-01", "a", 1, 2, 3, 5),
        (2, "2020-01-01", "b", 3, 2, 1, 5),
        (3, "2020-01-01", "c", 1, 2, 3, 5),
        (4, "2020-01-01", "d", 1, 3, 2, 5),
        (5, "2020-01-01", "e", 2, 2, 3, 5),
    )
    got = {r.parsed_as: (r.largest, r.middle, r.smallest, r.ranked_rows) for r in quality.column_order_audit(df).collect()}
    assert got["price_high"] == (0.5, 0.25, 0.25, 4)
    assert got["price_mode"] == (0.25, 0.75, 0.0, 4)
    assert got["price_low"] == (0.25, 0.0, 0.75, 4)


def test_thresholds_come_from_positive_prices_only(rows):
    data = [(i, "2020-01-01", "a", 1, p, 9, 1) for i, p in enumerate([10.0, 11.0, 12.0, 13.0, 0.0, -5.0, 500.0])]
    data += [(20, "2020-01-01", "few", 1, 5.0, 9, 1), (21, "2020-01-01", "few", 1, 6.0, 9, 1)]
    data += [(30 + i, "2020-01-01", "flat", 1, 5.0, 9, 1) for i in range(4)]
    data += [(40, "2020-01-01", "flat", 1, 50.0, 9, 1)]
    df = rows(*data)
    limits = {r.item: (r.median, r.scale) for r in quality.mad_thresholds(df).collect()}
    assert limits == {"a": (12.0, pytest.approx(1.4826))}
    # applied to every price, zero and negative included; no threshold, no flag
    flags = dict(table(quality.flag_outliers(df, k=6.0), "ordinal", "outlier"))
    assert flags[4] == 1 and flags[5] == 1 and flags[6] == 1
    assert flags[0] == flags[3] == flags[20] == flags[40] == 0


def test_a_price_exactly_k_away_is_no_outlier(spark):
    df = spark.createDataFrame([("a", 14.0), ("a", 14.1)], "item string, price_mode double")
    limits = spark.createDataFrame([("a", 10.0, 2.0)], "item string, median double, scale double")
    got = table(quality.flag_outliers(df, limits, k=2.0), "price_mode", "outlier")
    assert got == [(14.0, 0), (14.1, 1)]


def test_usable_and_merges(spark, rows):
    df = rows(
        (1, "2020-01-01", "a", 1, 2, 3, 5),
        (2, "2020-01-01", "a", 1, 2, 3, 5),
        (3, "2020-01-01", "b", 3, 2, 1, 5),
        (4, "2020-01-01", "c", None, 2, 3, 5),
        (5, "2020-01-01", "d", 0, 0, 3, 5),
        (6, "2020-01-01", "e", 1, 2, 3, 5),
    )
    merges = spark.createDataFrame([("e", "a")], "from_item string, to_item string")
    clean = quality.clean_prices(df, merges)
    got = {r.ordinal: (r.item, r.item_raw, r.duplicate, r.usable) for r in clean.collect()}
    assert len(got) == 6  # rows are flagged, never dropped
    assert got[1] == ("a", "a", 0, 1)
    assert got[2] == ("a", "a", 1, 0)
    assert [got[i][3] for i in (3, 4, 5)] == [0, 0, 0]
    # the merge makes a second usable "a" on that day: it runs after the flags
    assert got[6] == ("a", "e", 0, 1)


def test_missing_audit(rows):
    df = rows(
        (1, "2020-01-01", "a", 0, 2, 3, None),
        (2, "2020-01-01", "a", None, 0, 3, 0),
        (3, "2020-01-01", "a", 1, 2, 3, 4),
    )
    assert tuple(quality.missing_audit(df).first()) == (3, 1, 2, 2)


def test_local_rule_against_plain_python(spark, rows):
    rng = random.Random(3)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(0, 90)]
    data, ordinal = [], 0
    for day in days:
        for item in ("a", "b"):
            for _ in range(rng.choice([0, 1, 1, 2])):
                price = float(rng.choice([10, 11, 12, 13, 40, 0]))
                data.append((ordinal, day.isoformat(), item, 1.0, price, 50.0, 1.0))
                ordinal += 1
    first = {}
    for o, d, item, _, price, *_ in data:
        if price > 0:
            first.setdefault((item, d), price)
    expected = {}
    for o, d, item, _, price, *_ in data:
        here = dt.date.fromisoformat(d)
        near = [
            p
            for (i, x), p in first.items()
            if i == item and abs((dt.date.fromisoformat(x) - here).days) <= 10
        ]
        flag = 0
        if (item, d) in first and len(near) >= 3:
            middle = statistics.median(near)
            scale = 1.4826 * statistics.median([abs(p - middle) for p in near])
            flag = int(scale > 0 and abs(price - middle) > 3 * scale)
        expected[o] = flag
    got = dict(table(quality.flag_local_outliers(rows(*data), k=3.0), "ordinal", "outlier"))
    assert got == expected and sum(expected.values()) > 0


@pytest.mark.parametrize("hot", [1, 3000])
def test_exact_quantiles_equal_numpy(spark, hot):
    rng = random.Random(hot)
    data = [("hot", rng.choice([1.5, 2.0, 1e6, -3.0, 0.0, rng.uniform(-50, 50)])) for _ in range(hot)]
    data += [(None, rng.lognormvariate(0, 3)) for _ in range(101)]
    data += [("same", 7.25)] * 40 + [("gap", None), ("gap", float("nan")), ("gap", 4.0)]
    df = spark.createDataFrame(data, "k string, v double")
    probs = {"p0": 0.0, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", probs).collect()}
    for key in {k for k, _ in data}:
        values = [v for k, v in data if k == key and v is not None and v == v]
        assert got[key].n == len(values)
        for name, p in probs.items():
            assert got[key][name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)


def test_exact_quantiles_with_weights(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 5.0, 1), ("a", 2.0, 2)], "k string, v double, w long")
    row = exact_quantiles(df, ["k"], "v", {"m": 0.5, "q": 0.9}, weight="w").first()
    assert (row.n, row.m, row.q) == (6, 1.5, pytest.approx(np.quantile([1, 1, 1, 2, 2, 5], 0.9)))


def test_narrow_ranges_are_cut_until_they_fit(spark):
    """Very many distinct values within one bucket, beside repeats, a null key and a group of one value."""
    near = spark.range(200_000).select(F.lit("near").alias("k"), (1000 + F.col("id") * 1e-9).alias("v"), F.lit(1).alias("w"))
    far = spark.createDataFrame([(None, 5.0, 3), (None, -5.0, 1), ("one", 2.0, 90_000), ("near", 1000.0, 50_000), ("near", 9.0, 0)], "k string, v double, w int")
    probs = {"a": 0.0, "m": 0.5, "q": 0.9, "z": 1.0}
    got = {r.k: r for r in exact_quantiles(near.union(far), ["k"], "v", probs, weight="w", values_per_task=10).collect()}
    near_values = np.concatenate([1000 + np.arange(200_000) * 1e-9, np.full(50_000, 1000.0)])
    for key, data in {"near": near_values, None: np.array([5.0, 5.0, 5.0, -5.0]), "one": np.full(90_000, 2.0)}.items():
        assert got[key].n == data.size
        for name, p in probs.items():
            assert got[key][name] == pytest.approx(np.quantile(data, p), rel=1e-15, abs=1e-12)
    assert len(got) == 3


def test_mad_against_plain_python(spark):
    rng = random.Random(11)
    data = [(k, rng.gauss(100, 30)) for k in "abc" for _ in range(500 if k == "a" else 7)] + [("d", 1.0), ("d", 2.0)]
    got = {r.k: (r.median, r.scale) for r in exact_mad(spark.createDataFrame(data, "k string, v double"), ["k"], "v").collect()}
    assert set(got) == set("abc")
    for key, (median, scale) in got.items():
        values = [v for k, v in data if k == key]
        assert median == pytest.approx(statistics.median(values))
        assert scale == pytest.approx(1.4826 * statistics.median([abs(v - statistics.median(values)) for v in values]))


def test_numbering_is_gapless_and_ordered(spark):
    rng = random.Random(2)
    data = [(i * 37, rng.choice([1, 1, 1, 5, 90])) for i in range(400)]
    rng.shuffle(data)
    got = number_rows(spark.createDataFrame(data, "o long, n long"), "n", "o", "id").collect()
    expected = {o: i for i, (o, _) in enumerate(sorted(data, key=lambda t: (-t[1], t[0])))}
    assert {r.o: r.id for r in got} == expected


def test_flags_do_not_depend_on_partitioning(rows):
    rng = random.Random(9)
    data = [
        (i, f"2020-01-{rng.randint(1, 9):02d}", rng.choice("aaab"), 1.0, rng.uniform(1, 100), 200.0, 1.0) for i in range(300)
    ]
    df = rows(*data)
    columns = ["ordinal", "outlier", "duplicate", "usable"]
    once = table(quality.clean_prices(df.repartition(7, F.rand(1)), k=1.0), *columns)
    again = table(quality.clean_prices(df.coalesce(1).orderBy(F.desc("price_mode")), k=1.0), *columns)
    assert once == again
