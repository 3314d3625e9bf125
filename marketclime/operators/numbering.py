"""Gapless numbering of rows without sorting them all in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketclime.functions.numbers import order_bucket


def number_rows(df: DataFrame, size: str, ordinal: str, alias: str) -> DataFrame:
    """Number rows from 0 by ``size`` descending, then ``ordinal`` ascending.

    ``size`` is a positive row count, so it takes at most about sqrt(2 * total
    rows) distinct values, and ``ordinal`` is cut into order-keeping buckets.
    The offsets are running sums over those two small tables; rows themselves
    are only ordered inside one (size, bucket) cell.
    """
    cells = df.withColumn("_bucket", order_bucket(F.col(ordinal), per_octave=4096))
    per_cell = cells.groupBy(size, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    in_size = Window.partitionBy(size).orderBy("_bucket")
    per_cell = per_cell.withColumn("_cell_offset", F.sum("_n").over(in_size) - F.col("_n"))
    per_size = per_cell.groupBy(size).agg(F.sum("_n").alias("_m"))
    # a window without keys, over one row per distinct row count
    larger = Window.orderBy(F.col(size).desc())
    per_size = per_size.select(size, (F.sum("_m").over(larger) - F.col("_m")).alias("_size_offset"))
    offsets = per_cell.join(per_size, size).select(
        size, "_bucket", (F.col("_size_offset") + F.col("_cell_offset")).alias("_offset")
    )
    place = F.row_number().over(Window.partitionBy(size, "_bucket").orderBy(ordinal))
    return (
        cells.join(offsets, [size, "_bucket"])
        .withColumn(alias, (F.col("_offset") + place - 1).cast("long"))
        .drop("_bucket", "_offset")
    )
