"""Small reference tables: item mapping, merges, crop parameters, yields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketclime.functions.text import month_numbers, plain_number, strip
from marketclime.sources.tables import with_line_ordinal

MAPPING_FIELDS = [
    "item",
    "crop_id",
    "days_seen",
    "first_seen",
    "last_seen",
    "median_mode_price",
    "peak_month",
    "trough_month",
    "median_qty_t",
    "notes",
]

_SOURCED = "struct<value: double, src: string>"
_STAGES = "struct<ini: int, dev: int, mid: int, late: int, total: int, plant_date: string, region: string, src: string>"
CROP_FIELDS = (
    "id: string, name_en: string, name_ar: string, fao56_group: string, "
    f"kc: struct<ini: {_SOURCED}, mid: {_SOURCED}, end: {_SOURCED}>, height_m: {_SOURCED}, "
    f"stage_lengths_days: array<{_STAGES}>, frost_tolerant: boolean, heat_threshold_c: double, GAP: string"
)


def read_csv(spark: SparkSession, path: str, fields: list[str], ordinal: str | None = None) -> DataFrame:
    """A headed CSV with all columns as text; a byte order mark is skipped, absent columns are null.

    ``ordinal`` names a column to add that follows the files' path order and the rows' order within them.
    """
    df = spark.read.option("header", True).option("escape", '"').option("enforceSchema", False).csv(path)
    wanted = [(F.col(f) if f in df.columns else F.lit(None).cast("string")).alias(f) for f in fields]
    return with_line_ordinal(df, ordinal).select(*wanted, ordinal) if ordinal else df.select(*wanted)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Manual columns of an existing mapping: item, crop_id, notes; the last row per item wins."""
    rows = read_csv(spark, path, ["item", "crop_id", "notes"], "_row")
    named = rows.withColumn("item", strip(F.col("item"))).filter(F.col("item") != "")
    values = [F.coalesce(strip(F.col(c)), F.lit("")).alias(c) for c in ("crop_id", "notes")]
    return (
        named.groupBy("item").agg(F.max_by(F.struct(*values), "_row").alias("v")).select("item", "v.*")
    )


def crop_tags(mapping: DataFrame) -> DataFrame:
    """Items that carry a crop: blank and parked ("ignore") entries left out."""
    crop = strip(F.col("crop_id"))
    return mapping.filter((crop != "") & (crop != "ignore")).select("item", crop.alias("crop_id"))


def crop_members(mapping: DataFrame) -> DataFrame:
    """Items per crop. The mapping is filled in by hand, so a crop's list stays short."""
    return crop_tags(mapping).groupBy("crop_id").agg(
        F.sort_array(F.collect_list("item")).alias("members"), F.count(F.lit(1)).alias("n")
    )


def read_merges(spark: SparkSession, path: str) -> DataFrame:
    """Reviewed renames: from_item, to_item; the last row per from_item wins."""
    rows = read_csv(spark, path, ["from_item", "to_item"], "_row")
    return (
        rows.select(strip(F.col("from_item")).alias("from_item"), strip(F.col("to_item")).alias("to_item"), "_row")
        .groupBy("from_item")
        .agg(F.max_by("to_item", "_row").alias("to_item"))
    )


def read_crops(spark: SparkSession, path: str) -> DataFrame:
    """Crop parameters: one row per crop of a nested JSON document with a ``crops`` array."""
    document = spark.read.schema(f"crops array<struct<{CROP_FIELDS}>>").option("multiLine", True).json(path)
    return document.select(F.inline("crops"))


def crop_listing(crops: DataFrame) -> DataFrame:
    """Readiness of each crop: variants, frost label and what is missing."""
    variants = F.coalesce(F.size("stage_lengths_days"), F.lit(0))
    ready = F.col("kc.mid.value").isNotNull() & (variants > 0)
    gap = F.concat(F.lit("INCOMPLETE: "), F.coalesce("GAP", F.lit("")))
    return crops.select(
        "id",
        "name_en",
        variants.alias("variants"),
        F.when(F.coalesce("frost_tolerant", F.lit(False)), "tolerant").otherwise("sensitive").alias("frost"),
        F.when(ready, "ready").otherwise(gap).alias("status"),
    )


def crop_variants(crops: DataFrame) -> DataFrame:
    """One row per usable (crop, variant) with stage lengths, planting months and coefficients.

    Stage lengths are the published parts; the published total is ignored.
    """
    usable = crops.filter(F.col("kc.mid.value").isNotNull())
    rows = usable.select("*", F.posexplode("stage_lengths_days").alias("variant", "stage"))
    return rows.select(
        F.col("id").alias("crop_id"),
        "variant",
        F.col("stage.ini").alias("ini"),
        F.col("stage.dev").alias("dev"),
        F.col("stage.mid").alias("mid"),
        F.col("stage.late").alias("late"),
        month_numbers(F.col("stage.plant_date")).alias("months"),
        F.col("kc.ini.value").alias("kc_ini"),
        F.col("kc.mid.value").alias("kc_mid"),
        F.col("kc.end.value").alias("kc_end"),
        F.col("height_m.value").alias("height"),
        F.coalesce("frost_tolerant", F.lit(False)).alias("frost_tolerant"),
        F.col("heat_threshold_c").alias("heat_threshold"),
    )


def read_yields(spark: SparkSession, path: str) -> DataFrame:
    """Published yields: item_code, year, value, unit; rows without a year or value are skipped."""
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    by_lower = {c.lower(): c for c in raw.columns}

    def field(*names: str):
        found = next((by_lower[n] for n in names if n in by_lower), None)
        return F.col(f"`{found}`") if found else F.lit(None).cast("string")

    rows = raw.select(
        field("item code (fao)", "item code", "item_code").alias("item_code"),
        strip(field("year")).try_cast("int").alias("year"),
        plain_number(field("value")).alias("value"),
        F.coalesce(strip(field("unit")), F.lit("")).alias("unit"),
    )
    return rows.filter(F.col("year").isNotNull() & F.col("value").isNotNull())
