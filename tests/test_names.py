import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marketclime.operators import names


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_blocking_finds_every_near_pair(spark):
    rng = random.Random(4)
    words = {""} | {"".join(rng.choice("ab ت") for _ in range(rng.randint(0, 7))) for _ in range(150)}
    df = spark.createDataFrame([(w,) for w in words], "norm string")
    got = {(r.norm_a, r.norm_b, r.edit_distance) for r in names.near_names(df).collect()}
    expected = {
        (a, b, distance(a, b)) for a in words for b in words if a.encode() < b.encode() and distance(a, b) <= 2
    }
    assert got == expected


def observations(rows, spec):
    data, ordinal = [], 0
    for item, days in spec:
        for day in days:
            data.append((ordinal, f"2020-{1 + day // 28:02d}-{1 + day % 28:02d}", item, 1.0, 2.0, 3.0, 1.0))
            ordinal += 1
    return rows(*data)


def test_pairs_are_judged_by_shared_days(rows):
    df = observations(
        rows,
        [
            ("صبر", range(100)),
            ("صبار", [150]),
            ("توت", range(50)),
            ("موز", range(40, 53)),
            ("فجل", range(3)),
            ("فجـل", range(3, 6)),  # the same name stretched: no pair
        ],
    )
    got = {(r.item_a, r.item_b): r for r in names.near_duplicate_pairs(df).collect()}
    rename = got["صبر", "صبار"]
    assert (rename.edit_distance, rename.days_a, rename.days_b, rename.shared_days) == (1, 100, 1, 0)
    assert rename.verdict == "possible rename"
    fruit = got["توت", "موز"]
    assert (fruit.edit_distance, fruit.shared_days) == (2, 10)
    assert fruit.cooccurrence_rate == pytest.approx(0.769) and fruit.verdict == "DIFFERENT (co-occur)"
    assert not any({"فجل", "فجـل"} == set(pair) for pair in got)


def test_spelling_groups(rows):
    df = observations(
        rows, [("بندورة", range(30)), ("بندوره", range(15, 40)), ("أحمر", range(5)), ("احمر", range(8, 20)), ("x", [1])]
    )
    got = {r.item: r for r in names.exact_name_groups(df).collect()}
    assert set(got) == {"بندورة", "بندوره", "أحمر", "احمر"}
    assert got["بندورة"].max_shared_days == 15 and got["بندورة"].verdict.startswith("CO-OCCUR")
    assert got["احمر"].max_shared_days == 0 and got["احمر"].verdict.startswith("likely same")


def test_committed_review_examples(spark):
    """Distances are on normalised names."""
    review = [("كرمب", "كمــه", 2), ("كيل ( كرنب اجعد )", "كيل ( كرنب مجعد )", 1)]
    df = spark.createDataFrame([(n,) for pair in review for n in pair[:2]], "item string")
    near = names.near_names(names.normalise_names(df).select("norm")).collect()
    assert sorted(r.edit_distance for r in near) == [1, 2]
    assert df.select(F.levenshtein(F.lit("كرمب"), F.lit("كمــه")).alias("d")).first().d == 4


def test_shared_days_by_bits_equal_sets_of_days(spark):
    rng = random.Random(9)
    start = dt.date(1969, 10, 1)  # blocks on both sides of day 0
    listed = {item: {start + dt.timedelta(rng.randrange(400)) for _ in range(rng.randrange(1, 200))} for item in "abcde"}
    days = [(item, d, i) for item, held in listed.items() for i, d in enumerate(held)] + [("a", None, 0), ("b", None, 0)]
    df = spark.createDataFrame(days, "item string, date date, ordinal long")
    pairs = [(a, b) for a in listed for b in listed if a < b]
    got = names.shared_days(spark.createDataFrame(pairs, "item_a string, item_b string"), df).collect()
    assert {(r.item_a, r.item_b): r.shared_days for r in got} == {(a, b): len(listed[a] & listed[b]) for a, b in pairs}
    assert names.day_bits(df.limit(0)).collect() == []


def test_no_join_meets_on_dates(rows):
    df = rows(*[(i, f"2020-01-{1 + i:02d}", "name" + "s" * (i % 2), 1, 2, 3, 4) for i in range(20)])
    for run in (names.near_duplicate_pairs, names.exact_name_groups):
        plan = run(df)._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.splitlines() if "Join" in line and "date" in line]
