"""Loads, positions and versions of a store."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketclime.sources import store as stores
from marketclime.sources.store import PLACES, LoadConflict, LoadStore
from marketclime.streaming import ingest

DDL = "file string, line long, date date, item string, price_mode double, month string"


def frame(spark, *rows):
    return spark.createDataFrame([(f, n, dt.date(2020, m, 1), item, 1.0 * n, f"2020-{m:02d}") for f, n, m, item in rows], DDL)


def held(store, number=None):
    return sorted((r.load, r.ordinal - r.load * PLACES, r.file, r.line, r.item) for r in store.read(number).collect())


def test_positions_follow_load_file_and_row(spark, tmp_path):
    store = LoadStore(spark, str(tmp_path / "s"))
    assert store.read() is None and store.loads() == []
    first = frame(spark, ("b", 1, 1, "x"), ("a", 2, 1, "x"), ("a", 1, 2, "y")).repartition(3)
    assert store.append(first, "w", 0, ["file", "line"]) == 0
    assert store.append(frame(spark, ("a", 1, 1, "z")), "w", 1, ["file", "line"]) == 1
    assert held(store) == [(0, 0, "a", 1, "y"), (0, 1, "a", 2, "x"), (0, 2, "b", 1, "x"), (1, 0, "a", 1, "z")]
    assert held(store, 0) == held(store)[:3]  # an older version stays readable
    assert [(x["load"], x["writer"], x["batch"], x["partitions"]) for x in store.loads()] == [
        (0, "w", 0, ["2020-01", "2020-02"]), (1, "w", 1, ["2020-01"]),
    ]


def test_places_of_many_ranges_are_dense(spark):
    rows = spark.range(5000).select((F.col("id") * 37 % 5000).alias("k"))
    got = stores.with_places(rows.repartition(7), ["k"]).collect()
    assert all(r.k == r.place for r in got) and len(got) == 5000
    assert stores.with_places(rows.limit(0), ["k"]).columns == ["k", "place"]


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    store = LoadStore(spark, str(tmp_path / "s"))
    rows = frame(spark, ("a", 1, 1, "x"), ("a", 2, 1, "x"))
    assert store.append_new(rows, "w", 3, ["line"], dedupe_batch=False) == 0
    before = held(store)
    assert store.append_new(rows, "w", 3, ["line"], dedupe_batch=False) is None
    assert store.append(rows, "w", 2, ["line"]) is None and held(store) == before
    # another writer's batch of that number is another batch; its keys are stored already
    assert store.append_new(rows, "v", 3, ["line"]) is None and held(store) == before
    assert store.done("v", 3) and store.done("w", 0) and not store.done("v", 4)


def test_pruned_partitions_are_not_listed(spark, tmp_path):
    store = LoadStore(spark, str(tmp_path / "s"))
    store.append(frame(spark, *[("a", n, 1 + n % 12, f"i{n}") for n in range(48)]), "w", 0, ["line"])
    one = store.read(partitions=["2020-05"])
    assert one.count() == 4 and all("month=2020-05" in f for f in one.inputFiles())
    assert store.read(partitions=["1999-01"]).count() == 0


def test_a_reader_during_a_rewrite_sees_a_whole_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    store = LoadStore(spark, root, "month")
    store.append(frame(spark, ("a", 1, 1, "x"), ("a", 2, 1, "y"), ("a", 3, 2, "z")), "w", 0, ["line"])
    old = held(store)
    seen = []
    commit = LoadStore._commit

    def watched(self, *args):
        seen.append(held(LoadStore(spark, root)))  # all files are written, the version is not named yet
        commit(self, *args)

    monkeypatch.setattr(LoadStore, "_commit", watched)
    store.merge(frame(spark, ("b", 9, 1, "y")), "m", 0, ["line"], ["date", "item"])
    assert seen == [old]
    assert held(store) == [(0, 0, "a", 1, "x"), (0, 2, "a", 3, "z"), (1, 0, "b", 9, "y")]

    # cut short before the commit: nothing changed, and the next try goes through
    monkeypatch.setattr(LoadStore, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    now = held(store)
    with pytest.raises(RuntimeError):
        store.merge(frame(spark, ("c", 1, 1, "x")), "m", 1, ["line"], ["date", "item"])
    assert held(store) == now
    monkeypatch.setattr(LoadStore, "_commit", commit)
    assert store.merge(frame(spark, ("c", 1, 1, "x")), "m", 1, ["line"], ["date", "item"]) == 2
    assert (2, 0, "c", 1, "x") in held(store) and len(held(store)) == 3


def test_of_two_writers_at_once_one_fails(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    store, other = LoadStore(spark, root), LoadStore(spark, root)
    commit = LoadStore._commit

    def overtaken(self, *args):
        monkeypatch.setattr(LoadStore, "_commit", commit)
        other.append(frame(spark, ("o", 1, 1, "x")), "other", 0, ["line"])
        commit(self, *args)

    monkeypatch.setattr(LoadStore, "_commit", overtaken)
    with pytest.raises(LoadConflict):
        store.append(frame(spark, ("s", 1, 1, "y")), "mine", 0, ["line"])
    assert held(store) == [(0, 0, "o", 1, "x")]
    assert store.append(frame(spark, ("s", 1, 1, "y")), "mine", 0, ["line"]) == 1 and len(held(store)) == 2


def test_other_columns_are_refused(spark, tmp_path):
    store = LoadStore(spark, str(tmp_path / "s"))
    store.append(frame(spark, ("a", 1, 1, "x")), "w", 0, ["line"])
    with pytest.raises(ValueError, match="price_mode"):
        store.append(frame(spark, ("a", 1, 1, "x")).drop("price_mode"), "w", 1, ["line"])


def test_stream_batches_are_loads(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "s")

    def run(checkpoint):
        rows = spark.readStream.schema("file string, line long, date date, item string, price_mode double").parquet(source)
        ingest.ingest_loads(rows, root, str(tmp_path / checkpoint), ["file", "line"])
        return held(LoadStore(spark, root))

    for batch in ([("a", 1, 1, "x"), ("a", 2, 1, "x")], [("a", 1, 1, "x"), ("b", 7, 2, "y")]):
        frame(spark, *batch).drop("month").coalesce(1).write.mode("append").parquet(source)
        got = run("c1")
    assert got == [(0, 0, "a", 1, "x"), (1, 1, "b", 7, "y")]
    assert run("c2") == got  # everything replayed, as after a lost checkpoint


def test_settled_weather_and_later_loads_win(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "s")
    day = dt.date(2020, 12, 31)
    ddl = "site_id long, date date, tmax double, source string, line long"

    def run(*rows):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ddl).parquet(source)
        ingest.ingest_weather_loads(stream, root, str(tmp_path / "c"), ["line"])
        return {r.site_id: (r.tmax, r.load) for r in LoadStore(spark, root, "year").read().collect()}

    # the place within a load starts anew; the later load still comes after
    assert run((1, day, 1.0, "preliminary", 8), (2, day, 2.0, "preliminary", 9)) == {1: (1.0, 0), 2: (2.0, 0)}
    assert run((1, day, 3.0, "preliminary", 1), (2, day, 4.0, "era5_archive", 2)) == {1: (3.0, 1), 2: (4.0, 1)}
    assert run((1, day, 5.0, "preliminary", 1), (2, day, 6.0, "preliminary", 2)) == {1: (5.0, 2), 2: (4.0, 1)}
