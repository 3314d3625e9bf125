"""National yield series to one unit and one summary row per crop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketclime.functions.text import kg_per_dunum
from marketclime.operators.quantiles import exact_quantiles


def yield_summary(crops: DataFrame, yields: DataFrame) -> DataFrame:
    """Median, range and span of kg per dunum for every crop of the list.

    ``crops`` has crop, item_code, label and caveat; several crops may share an
    item. A crop without rows, or with rows of unknown units only, keeps a null
    figure and a note. The unit shown is that of the earliest row.
    """
    converted = yields.withColumn("kg", kg_per_dunum(F.col("value"), F.col("unit")))
    good = converted.filter(F.col("kg").isNotNull())
    median = exact_quantiles(good, ["item_code"], "kg", {"median": 0.5})
    span = converted.groupBy("item_code").agg(
        F.min("kg").alias("min"),
        F.max("kg").alias("max"),
        F.min(F.when(F.col("kg").isNotNull(), F.col("year"))).alias("first_year"),
        F.max(F.when(F.col("kg").isNotNull(), F.col("year"))).alias("last_year"),
        F.min_by("unit", F.struct("year", "value", "unit")).alias("unit_reported"),
    )
    unknown_unit = F.concat(F.lit("Unrecognised unit '"), F.col("unit_reported"), F.lit("'."))
    return (
        crops.join(span, "item_code", "left")
        .join(median, "item_code", "left")
        .select(
            "crop",
            F.round("median", 1).alias("kg_per_dunum"),
            F.round("min", 1).alias("min"),
            F.round("max", 1).alias("max"),
            "first_year",
            "last_year",
            F.coalesce("n", F.lit(0).cast("long")).alias("n"),
            "label",
            "unit_reported",
            "caveat",
            F.when(F.col("unit_reported").isNull(), "No yield rows returned.")
            .when(F.col("median").isNull(), unknown_unit)
            .alias("note"),
        )
    )
