"""Weather files and column-oriented payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketclime.functions.text import iso_date, plain_number
from marketclime.operators.ingest import last_row_per_day
from marketclime.sources.reference import read_csv

# Names of the published daily variables.
DAILY_VARIABLES = [
    "temperature_2m_max",
    "temperature_2m_min",
    "temperature_2m_mean",
    "precipitation_sum",
    "rain_sum",
    "et0_fao_evapotranspiration",
    "shortwave_radiation_sum",
    "wind_speed_10m_max",
    "relative_humidity_2m_mean",
]
SHORT_NAMES = {
    "temperature_2m_max": "tmax",
    "temperature_2m_min": "tmin",
    "temperature_2m_mean": "tmean",
    "precipitation_sum": "precip",
    "et0_fao_evapotranspiration": "et0",
    "wind_speed_10m_mean": "wind_mean",
    "wind_speed_10m_max": "wind_max",
}


def read_weather(spark: SparkSession, path: str, site: Column | None = None) -> DataFrame:
    """Weather CSV, one row per (site, date); the last row of a date wins, "None" and blanks are null.

    Without a ``site_id`` column the file is one site, named by ``site``.
    """
    fields = ["site_id", "date", *SHORT_NAMES, "source"]
    raw = read_csv(spark, path, fields, "ordinal")
    rows = raw.select(
        F.coalesce("site_id", F.lit("site") if site is None else site).alias("site_id"),
        iso_date(F.col("date")).alias("date"),
        *[plain_number(F.col(name)).alias(short) for name, short in SHORT_NAMES.items()],
        F.coalesce("source", F.lit("")).alias("source"),
        "ordinal",
    )
    return last_row_per_day(rows.filter(F.col("date").isNotNull()))


def payload_rows(
    payloads: DataFrame, variables: Sequence[str] = DAILY_VARIABLES, daily: str = "daily", keep: Sequence[str] = ()
) -> DataFrame:
    """Parallel arrays under ``daily`` (``time`` and one per variable) to one row per day.

    Arrays shorter than ``time`` are padded with null; a variable the payload
    does not have is null throughout.
    """
    present = {f.name for f in payloads.schema[daily].dataType.fields}
    numbered = payloads.select(*keep, F.col(daily), F.posexplode(f"{daily}.time").alias("_i", "date"))
    values = [
        (F.get(F.col(f"{daily}.{v}"), F.col("_i")) if v in present else F.lit(None).cast("double")).alias(v)
        for v in variables
    ]
    return numbered.select(*keep, iso_date(F.col("date")).alias("date"), *values)


def zipped_rows(payloads: DataFrame, arrays: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Top-level parallel arrays to rows; shorter ones are padded with null."""
    return payloads.select(*keep, F.inline(F.arrays_zip(*arrays)))
