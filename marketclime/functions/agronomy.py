"""FAO-56 single crop coefficient arithmetic as native column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def clamp(v: Column, lo: float, hi: float) -> Column:
    """``v`` limited to [lo, hi]; null stays null."""
    return F.when(v.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), v)))


def saturation_vapour_pressure(t: Column) -> Column:
    """kPa, FAO-56 Eq. 11."""
    return 0.6108 * F.exp(17.27 * t / (t + 237.3))


def wind_at_2m(kmh_at_10m: Column) -> Column:
    """km/h at 10 m to m/s at 2 m, FAO-56 Eq. 47."""
    return kmh_at_10m / 3.6 * 4.87 / math.log(67.8 * 10 - 5.42)


def rh_min(tmin: Column, tmax: Column, arid_correction: float = 2.0) -> Column:
    """Minimum relative humidity in percent, FAO-56 Eq. 64 with the arid-climate correction."""
    return 100.0 * saturation_vapour_pressure(tmin - arid_correction) / saturation_vapour_pressure(tmax)


def adjust_kc(kc: Column, u2: Column, rhmin: Column, height: Column) -> Column:
    """Climate adjustment of a tabulated Kc, FAO-56 Eq. 62 and 65; unadjusted if weather is unknown."""
    shift = 0.04 * (clamp(u2, 1, 6) - 2.0) - 0.004 * (clamp(rhmin, 20, 80) - 45.0)
    adjusted = kc + shift * F.pow(clamp(height, 0.1, 10) / 3.0, F.lit(0.3))
    return F.when(u2.isNull() | rhmin.isNull(), kc).otherwise(adjusted)


def kc_on_day(day, ini, dev, mid, late, kc_ini, kc_mid, kc_end) -> Column:
    """Kc on season day ``day`` (from 1): flat, rising, flat, then moving to the end value (Eq. 66)."""
    rise_end = ini + dev
    flat_end = rise_end + mid
    rise = kc_ini + (day - ini) / F.greatest(dev, F.lit(1)) * (kc_mid - kc_ini)
    fall = kc_mid + (day - flat_end) / F.greatest(late, F.lit(1)) * (kc_end - kc_mid)
    return F.when(day <= ini, kc_ini).when(day <= rise_end, rise).when(day <= flat_end, kc_mid).otherwise(fall)


def stage_of_day(day, ini, dev, mid) -> Column:
    """Growth stage 0-3 of season day ``day`` (from 1)."""
    return F.when(day <= ini, 0).when(day <= ini + dev, 1).when(day <= ini + dev + mid, 2).otherwise(3)


def mean_temperature(tmin: Column, tmax: Column) -> Column:
    return (tmax + tmin) / 2.0


def degree_days(tmin: Column, tmax: Column, base, cap=None) -> Column:
    """Growing degree days of one day, never negative; ``cap`` clips both extremes first."""
    if cap is not None:
        tmax = F.when(tmax.isNotNull(), F.least(tmax, _col(cap)))
        tmin = F.when(tmin.isNotNull(), F.least(tmin, _col(cap)))
    warmth = mean_temperature(tmin, tmax) - _col(base)
    return F.when(warmth.isNotNull(), F.greatest(F.lit(0.0), warmth))


# Heat sums of the same days differ in their last bits with the order of
# addition; a need that is met exactly must count as met in any order.
HEAT_TOLERANCE = 1e-9


def reached(heat: Column, need) -> Column:
    return heat + HEAT_TOLERANCE >= need


def gross_irrigation(etc_mm: Column, rain_mm: Column, rain_fraction: float, efficiency: float) -> Column:
    """Water to apply: demand less the usable part of the rain, over the application efficiency."""
    return F.greatest(F.lit(0.0), etc_mm - rain_fraction * rain_mm) / efficiency


def volume_m3(depth_mm: Column, dunums: float) -> Column:
    """1 mm over 1 dunum (1000 square metres) is 1 cubic metre."""
    return depth_mm * dunums
