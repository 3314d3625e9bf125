"""Small numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS_PER_OCTAVE = 256


def rounded(c: Column, digits: int = 1) -> Column:
    return F.round(c, digits)


def percent_change(now: Column, before: Column) -> Column:
    """100 * (now - before) / before; null where ``before`` is null or zero."""
    return F.when(before != 0, 100 * (now - before) / before)


def order_bucket(c: Column, per_octave: int = BUCKETS_PER_OCTAVE) -> Column:
    """A bucket number that never decreases as ``c`` grows.

    Each power of two is cut into ``per_octave`` equal parts, so the buckets
    depend on the value alone: every task and every retry agrees on them
    without a shared table of bounds. NaN must be filtered out first.
    """
    size = F.abs(c.cast("double"))
    octave = F.floor(F.log2(size))
    part = octave * per_octave + F.floor((size / F.pow(F.lit(2.0), octave) - 1) * per_octave)
    # octaves of magnitudes in [1e-300, 1e300] lie within +-1000
    number = F.when(size < 1e-300, 0).when(size > 1e300, 2100 * per_octave).otherwise(part + 1050 * per_octave)
    return (F.signum(c.cast("double")) * number).cast("long")
