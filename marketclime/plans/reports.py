"""The reports: operators composed from sources to outputs."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame

from marketclime.operators import climate, names, prices, profiles, quality, water
from marketclime.session import cut_lineage
from marketclime.sources import sinks
from marketclime.sources.reference import crop_tags


class PriceReport(NamedTuple):
    clean: DataFrame
    weekly: DataFrame
    seasonal: DataFrame
    index: DataFrame
    latest: DataFrame


class ClimateReport(NamedTuple):
    frost: DataFrame
    monthly: DataFrame
    heat: DataFrame
    seasons: DataFrame
    distribution: DataFrame


def price_report(
    rows: DataFrame,
    mapping: DataFrame,
    merges: DataFrame | None = None,
    min_days: int = prices.MIN_DAYS,
    outlier_rule: str = "global",
) -> PriceReport:
    """Raw price rows to cleaned rows and the four tables made from them.

    The cleaned rows are written once, as every table reads them.
    """
    k = quality.MAD_K if outlier_rule == "global" else quality.LOCAL_MAD_K
    clean = cut_lineage(quality.clean_prices(rows, merges, k, outlier_rule), "clean")
    tags = crop_tags(mapping)
    return PriceReport(
        clean,
        prices.weekly_prices(clean),
        prices.seasonal_profile(clean),
        prices.series_index(clean, tags, min_days),
        prices.latest_snapshot(clean, tags),
    )


def write_price_report(report: PriceReport, folder: str) -> None:
    """Flagged rows, one JSON per series, the index and the latest day."""
    index = cut_lineage(report.index, "index")
    sinks.write_flagged(report.clean, f"{folder}/clean")
    sinks.write_series(sinks.series_payload(index, report.weekly, report.seasonal), f"{folder}/prices")
    sinks.write_json(sinks.index_payload(index), f"{folder}/prices_index")
    sinks.write_json(sinks.snapshot_payload(report.latest), f"{folder}/latest")


def audit_report(rows: DataFrame) -> dict[str, DataFrame]:
    """The quality audit by name: duplicates, column order, missing values, name pairs and groups."""
    return {
        "duplicates": quality.duplicate_audit(rows),
        "conflicts": quality.conflicting_examples(rows, 5),
        "column_order": quality.column_order_audit(rows),
        "missing": quality.missing_audit(rows),
        "name_pairs": names.near_duplicate_pairs(rows),
        "name_groups": names.exact_name_groups(rows),
        "summary": profiles.parse_summary(rows),
        "failures_by_year": profiles.order_failures_by_year(rows),
    }


def climate_report(weather: DataFrame) -> ClimateReport:
    """Frost windows, monthly climatology, heat days and rain seasons per site."""
    seasons = climate.hydro_rain(weather)
    return ClimateReport(
        climate.frost_summary(weather),
        climate.monthly_climatology_totals(weather),
        climate.heat_days(weather),
        seasons,
        climate.hydro_rain_distribution(seasons),
    )


def write_climate_report(report: ClimateReport, folder: str) -> None:
    """One nested document per site."""
    document = sinks.climate_document(report.frost, report.monthly, report.heat, report.seasons)
    sinks.write_json(document, f"{folder}/climate")


def planting_report(
    weather: DataFrame,
    variants: DataFrame,
    fw: float,
    efficiency: float,
    base: float,
    cap: float | None = None,
    dates: Sequence[tuple[int, int]] | None = None,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Season per candidate and the gated sweep table over planting dates."""
    years = water.calibration_years(weather)
    calibrated = water.calibrated_variants(weather, years, variants, base, cap)
    seasons = water.evaluate(
        calibrated, weather, years, water.sweep_dates() if dates is None else dates, fw, efficiency, cap, **options
    )
    seasons = cut_lineage(seasons, "seasons")
    return seasons, water.planting_sweep(seasons)
