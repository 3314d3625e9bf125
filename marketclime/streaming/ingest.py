"""Streams that keep the month store, the weather table and weekly counts up to date.

``foreachBatch`` writers run the batch operators on each micro-batch. They are
idempotent: a batch that is replayed after a failure finds its keys stored and
adds nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marketclime.operators.climate import SETTLED
from marketclime.operators.ingest import LOOKBACK_DAYS, latest_by, new_rows
from marketclime.operators.prices import weekly_prices
from marketclime.operators.quality import first_row_distinct
from marketclime.session import cut_lineage
from marketclime.sources.pages import requested_rows
from marketclime.sources.prices import with_month
from marketclime.sources.sinks import write_month_store
from marketclime.sources.store import LoadStore

WEEK_WINDOW = ("7 days", "7 days", "2 days")  # windows count from a Thursday; two days later is Saturday


def _stored(spark: SparkSession, path: str, schema) -> DataFrame | None:
    """The table at ``path``, or None before anything has been written there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _finish(writer, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    if not available_now:
        return writer.start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_new(batch: DataFrame, store: str, dedupe_batch: bool = True) -> None:
    """Append the rows whose (date, item) the month store does not hold yet.

    Only the stored months that occur in the batch are read: the semi join on
    the partition column prunes the rest at run time.
    """
    spark = batch.sparkSession
    rows = with_month(batch)
    stored = _stored(spark, store, "date date, item string, month string")
    if stored is None:
        fresh = first_row_distinct(rows) if dedupe_batch else rows
    else:
        touched = rows.select("month").distinct()
        fresh = new_rows(rows, stored.join(touched, "month", "left_semi"), dedupe_batch=dedupe_batch)
    # settled before the store changes under the plan that reads it
    write_month_store(cut_lineage(fresh.drop("month"), "fresh"), store)


def ingest_observations(
    rows: DataFrame, store: str, checkpoint: str, dedupe_batch: bool = True, available_now: bool = True
) -> StreamingQuery:
    """Stream of price rows into the month store; first row per (date, item) wins by ordinal."""
    writer = rows.writeStream.foreachBatch(lambda batch, _: append_new(batch, store, dedupe_batch))
    return _finish(writer, checkpoint, available_now)


def dedup_recent(rows: DataFrame, event_time: str = "ts", lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """One row per (date, item) within the look-back; late rows inside it still count.

    Which of several rows stays is not fixed; use :func:`ingest_observations`
    where the first must win.
    """
    return rows.withWatermark(event_time, f"{lookback_days} days").dropDuplicatesWithinWatermark(["date", "item"])


def weekly_counts(rows: DataFrame, event_time: str, key: str, value: str, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """Rows, sum, lowest and highest value per key and Saturday-start week, kept fresh while rows may be late."""
    week = F.window(event_time, *WEEK_WINDOW)
    return (
        rows.withWatermark(event_time, f"{lookback_days} days")
        .groupBy(week.alias("_week"), key)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(value).alias("total"),
            F.min(value).alias("lowest"),
            F.max(value).alias("highest"),
        )
        .select(F.to_date("_week.start").alias("week_start"), key, "n", "total", "lowest", "highest")
    )


def merge_versions(batch: DataFrame, batch_id: int, table: str, keys: list[str], partition: str) -> None:
    """Put updated rows in place of the stored ones with the same keys, partition by partition."""
    rows = batch.withColumn("version", F.lit(batch_id).cast("long"))
    stored = _stored(batch.sparkSession, table, rows.schema)
    if stored is not None:
        rows = stored.join(rows.select(partition).distinct(), partition, "left_semi").unionByName(rows)
    merged = cut_lineage(latest_by(rows, keys, F.col("version")), "versions")
    writer = merged.repartitionByRange(partition, *[k for k in keys if k != partition]).write
    writer.partitionBy(partition).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(table)


def publish_weekly(counts: DataFrame, table: str, checkpoint: str, key: str, available_now: bool = True) -> StreamingQuery:
    """Stream of :func:`weekly_counts` into a table by week; only the weeks that changed are rewritten."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        merge_versions(batch, batch_id, table, ["week_start", key], "week_start")

    return _finish(counts.writeStream.outputMode("update").foreachBatch(publish), checkpoint, available_now)


def merge_by_priority(batch: DataFrame, table: str) -> None:
    """Merge weather rows into a table of versions partitioned by year; settled rows replace preliminary ones.

    Only the years of the batch are rewritten. A year whose rows all survive
    unchanged is written again with the same content, so replays are harmless.
    """
    spark = batch.sparkSession
    rows = batch.withColumn("year", F.year("date"))
    stored = _stored(spark, table, rows.schema)
    if stored is not None:
        touched = rows.select("year").distinct()
        rows = stored.join(touched, "year", "left_semi").unionByName(rows)
    order = F.struct((F.col("source") == SETTLED).alias("settled"), F.col("ordinal").alias("o"))
    merged = cut_lineage(latest_by(rows, ["site_id", "date"], order), "weather")
    layout = merged.repartitionByRange("year", "site_id", "date")
    writer = layout.write.partitionBy("year").mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.parquet(table)


def ingest_weather(rows: DataFrame, table: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Stream of weather rows (site_id, date, values, source, ordinal) into the weather table."""
    writer = rows.writeStream.foreachBatch(lambda batch, _: merge_by_priority(batch, table))
    return _finish(writer, checkpoint, available_now)


def refresh_weeks(batch: DataFrame, clean_store: str, weekly_table: str) -> None:
    """Recompute exact weekly medians for the months touched by a batch of cleaned rows.

    Medians have no incremental state. The weeks that start in a touched month
    are computed again from the store of cleaned rows (partitioned by month;
    a week reaches into the next month at most) and replace the stored ones.
    """
    spark = batch.sparkSession
    starts = batch.select(F.explode(F.array(F.date_sub("date", 6), F.col("date"))).alias("date"))
    touched = with_month(starts).select("month").distinct()
    following = F.date_format(F.add_months(F.to_date("month", "yyyy-MM"), 1), "yyyy-MM")
    around = touched.select(F.explode(F.array("month", following)).alias("month")).distinct()
    store = spark.read.parquet(clean_store).withColumn("month", F.col("month").cast("string"))
    rows = store.join(around, "month", "left_semi")
    weeks = weekly_prices(rows).withColumn("month", F.date_format("week_start", "yyyy-MM"))
    fresh = cut_lineage(weeks.join(touched, "month", "left_semi"), "weeks")
    writer = fresh.write.partitionBy("month").mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.parquet(weekly_table)


def ingest_pages(
    pages: DataFrame, store: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Stream of fetched pages (path, html, expected) parsed and stored in the same pass."""

    def store_batch(batch: DataFrame, _: int) -> None:
        # written once: the parse would run again for the months and for the rows
        rows = cut_lineage(requested_rows(batch), "page-rows")
        # one page per requested day: the row number within the page orders its repeats
        append_new(rows.withColumnRenamed("row", "ordinal").drop("path"), store, dedupe_batch=False)

    return _finish(pages.writeStream.foreachBatch(store_batch), checkpoint, available_now)


def ingest_loads(
    rows: DataFrame, root: str, checkpoint: str, order: list[str], dedupe_batch: bool = True, available_now: bool = True
) -> StreamingQuery:
    """Stream of price rows into a :class:`LoadStore` by month: each micro-batch is a load with positions of its own.

    ``order`` names the columns that place rows within a load (file and row,
    say). A batch that is replayed finds itself in the load log and adds nothing.
    """

    def store_batch(batch: DataFrame, number: int) -> None:
        LoadStore(batch.sparkSession, root).append_new(with_month(batch), checkpoint, number, order, dedupe_batch)

    return _finish(rows.writeStream.foreachBatch(store_batch), checkpoint, available_now)


def ingest_page_loads(pages: DataFrame, root: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Stream of fetched pages (path, html, expected) parsed once and stored as loads; rows are placed by page, then row."""

    def store_batch(batch: DataFrame, number: int) -> None:
        store = LoadStore(batch.sparkSession, root)
        if not store.done(checkpoint, number):
            # written once: the parse would run again for the months and for the positions
            rows = cut_lineage(with_month(requested_rows(batch)), "page-rows")
            store.append_new(rows, checkpoint, number, ["path", "row"], dedupe_batch=False)

    return _finish(pages.writeStream.foreachBatch(store_batch), checkpoint, available_now)


def ingest_weather_loads(rows: DataFrame, root: str, checkpoint: str, order: list[str], available_now: bool = True) -> StreamingQuery:
    """Stream of weather rows (site_id, date, values, source) into a :class:`LoadStore` by year.

    Settled rows replace preliminary ones; among equals the later load wins,
    within a load the later place. Readers see a year before or after a
    rewrite, never half of it.
    """

    def store_batch(batch: DataFrame, number: int) -> None:
        years = batch.withColumn("year", F.year("date"))
        store = LoadStore(batch.sparkSession, root, "year")
        store.merge(years, checkpoint, number, order, ["site_id", "date"], lambda: (F.col("source") == SETTLED))

    return _finish(rows.writeStream.foreachBatch(store_batch), checkpoint, available_now)
