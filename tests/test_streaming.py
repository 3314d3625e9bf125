import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketclime.operators import prices, quality
from marketclime.sources import sinks
from marketclime.sources.prices import with_month
from marketclime.streaming import ingest

DDL = "ordinal long, date date, item string, price_mode double"


def drop(spark, folder, data, ddl=DDL):
    spark.createDataFrame(data, ddl).coalesce(1).write.mode("append").parquet(str(folder))


def stored(spark, path):
    return sorted((r.ordinal, r.date, r.item) for r in spark.read.parquet(str(path)).collect())


def test_ingest_is_idempotent_and_heals_late_rows(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    day = dt.date(2020, 1, 31)
    drop(spark, source, [(1, day, "a", 1.0), (2, day, "a", 2.0), (3, dt.date(2020, 2, 1), "a", 3.0)])

    def run(checkpoint):
        rows = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(str(source))
        ingest.ingest_observations(rows, store, str(tmp_path / checkpoint))
        return stored(spark, store)

    first = run("c1")
    assert first == [(1, day, "a"), (3, dt.date(2020, 2, 1), "a")]
    # late rows of a stored month, and a repeat of a stored key
    drop(spark, source, [(9, day, "a", 9.0), (10, dt.date(2020, 1, 2), "b", 9.0)])
    second = run("c1")
    assert second == sorted([*first, (10, dt.date(2020, 1, 2), "b")])
    # everything replayed from the start, as after a lost checkpoint
    assert run("c2") == second


def test_a_batch_can_keep_its_repeats(spark, tmp_path):
    store = str(tmp_path / "store")
    day = dt.date(2020, 1, 31)
    batch = spark.createDataFrame([(1, day, "a", 1.0), (2, day, "a", 2.0)], DDL)
    ingest.append_new(batch, store, dedupe_batch=False)
    ingest.append_new(batch, store, dedupe_batch=False)
    assert [r[0] for r in stored(spark, store)] == [1, 2]


def test_settled_weather_replaces_preliminary(spark, tmp_path):
    ddl = "site_id long, date date, tmax double, source string, ordinal long"
    source, table = tmp_path / "in", str(tmp_path / "w")
    day, later = dt.date(2020, 12, 31), dt.date(2021, 1, 1)

    def run():
        rows = spark.readStream.schema(ddl).parquet(str(source))
        ingest.ingest_weather(rows, table, str(tmp_path / "c"))
        return {(r.site_id, r.date): r.tmax for r in spark.read.parquet(table).collect()}

    drop(spark, source, [(1, day, 1.0, "preliminary", 1), (1, later, 2.0, "preliminary", 2)], ddl)
    assert run() == {(1, day): 1.0, (1, later): 2.0}
    drop(spark, source, [(1, day, 5.0, "era5_archive", 3), (2, day, 7.0, "preliminary", 4)], ddl)
    assert run() == {(1, day): 5.0, (1, later): 2.0, (2, day): 7.0}
    drop(spark, source, [(1, day, 9.0, "preliminary", 5)], ddl)
    assert run()[1, day] == 5.0


def test_weekly_counts_over_several_files_equal_batch(spark, tmp_path):
    ddl = "ts timestamp, key string, value double"
    source, table = tmp_path / "in", str(tmp_path / "weekly")
    start = dt.datetime(2026, 7, 25, 12, tzinfo=dt.timezone.utc)
    data = [(start + dt.timedelta(days=d), "k" if d % 3 else "m", float(d)) for d in range(20)]
    for part in (data[:9], data[14:], data[9:14]):  # late, but within the look-back
        drop(spark, source, part, ddl)
    rows = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(source))
    ingest.publish_weekly(ingest.weekly_counts(rows, "ts", "key", "value"), table, str(tmp_path / "c"), "key")
    got = {(r.week_start, r.key): (r.n, r.total) for r in spark.read.parquet(table).collect()}
    expected = {}
    for ts, key, value in data:
        week = ts.date() - dt.timedelta(days=(ts.date().weekday() - 5) % 7)
        n, total = expected.get((week, key), (0, 0.0))
        expected[week, key] = (n + 1, total + value)
    assert got == expected


def test_recent_rows_are_kept_once(spark, tmp_path):
    ddl = "ts timestamp, date date, item string"
    source, table = tmp_path / "in", str(tmp_path / "out")
    when = dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc)
    drop(spark, source, [(when, when.date(), "a"), (when, when.date(), "a")], ddl)
    drop(spark, source, [(when + dt.timedelta(days=3), when.date(), "a"), (when, when.date(), "b")], ddl)
    rows = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(source))
    writer = ingest.dedup_recent(rows).select("date", "item").writeStream.format("parquet")
    query = writer.option("path", table).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.item for r in spark.read.parquet(table).collect()) == ["a", "b"]


def test_touched_weeks_are_recomputed_exactly(spark, tmp_path, rows):
    clean_store, weekly = str(tmp_path / "clean"), str(tmp_path / "weekly")
    data = [(i, str(dt.date(2020, 1, 1) + dt.timedelta(days=i)), "a", 1, float(i), 99, 1) for i in range(100)]
    df = rows(*data).withColumn("usable", F.lit(1))
    sinks.write_month_store(df, clean_store)
    ingest.refresh_weeks(df, clean_store, weekly)
    late = rows((500, "2020-02-01", "a", 1, 77.0, 99, 1), (501, "2020-02-01", "b", 1, 77.0, 99, 1)).withColumn("usable", F.lit(1))
    sinks.write_month_store(late, clean_store)
    ingest.refresh_weeks(late, clean_store, weekly)
    columns = ["item", "week", "mode", "n"]
    got = sorted(tuple(r) for r in spark.read.parquet(weekly).select(*columns).collect())
    whole = prices.weekly_prices(spark.read.parquet(clean_store)).select(*columns)
    assert got == sorted(tuple(r) for r in whole.collect())


def test_pages_are_parsed_and_stored_in_one_pass(spark, tmp_path):
    from tests.test_sources import bulletin, line

    ddl = "path string, html string, expected date"
    source, store = tmp_path / "in", str(tmp_path / "store")
    day = dt.date(2015, 8, 5)
    drop(spark, source, [("p", bulletin(line("a"), line("a"), line("b")), day), ("q", bulletin(line("c", "01-01-2001")), day)], ddl)
    for checkpoint in ("c1", "c2"):
        arriving = spark.readStream.schema(ddl).parquet(str(source))
        ingest.ingest_pages(arriving, store, str(tmp_path / checkpoint))
    got = spark.read.parquet(store).collect()
    assert sorted((r.date, r.item, r.ordinal) for r in got) == [(day, "a", 0), (day, "a", 1), (day, "b", 2)]


def test_months_are_pruned_when_a_batch_is_matched(spark, tmp_path):
    store = str(tmp_path / "store")
    data = [(i, dt.date(2020, 1 + i % 12, 3), f"i{i}", 1.0) for i in range(48)]
    ingest.append_new(spark.createDataFrame(data, DDL), store)
    batch = with_month(spark.createDataFrame([(99, dt.date(2020, 5, 3), "new", 1.0)], DDL)).select("month").distinct()
    held = spark.read.parquet(store).join(F.broadcast(batch), "month", "left_semi")
    assert held.count() == 4 and quality.first_row_distinct(held.drop("month")).count() == 4


def test_stored_raises_on_other_errors(spark, tmp_path):
    path = tmp_path / "broken"
    path.mkdir()
    (path / "x.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        ingest._stored(spark, str(path), "date date").count()


def test_pages_are_parsed_once(spark, tmp_path, monkeypatch):
    cells = "".join(f"<td>{c}</td>" for c in ("a", "kg", "3", "2", "1", "5", ""))
    page = f"<table class='table-bordered'><tr><th>h</th></tr><tr>{cells}</tr></table>"
    df = spark.createDataFrame([("p/2000-01-01.html", page)], "path string, html string").withColumn("expected", F.lit("2000-01-01").cast("date"))
    df.write.parquet(str(tmp_path / "in"))
    seen = []

    def append(rows, store, dedupe_batch=True):
        seen.append((rows._jdf.queryExecution().optimizedPlan().toString(), rows.count()))

    monkeypatch.setattr(ingest, "append_new", append)
    arriving = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    ingest.ingest_pages(arriving, str(tmp_path / "store"), str(tmp_path / "c"))
    ((plan, n),) = seen
    # the rows are used twice there; before, each use parsed the pages
    assert n == 1 and "ArrowEvalPython" not in plan
