"""Calendar keys as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEK_OFFSET = 5  # epoch day 0 was a Thursday; +5 moves the week boundary to Saturday
FRIDAY = 4  # weekday() counts from Monday = 0


def week_key(d: Column) -> Column:
    """Number of the Saturday-start week that holds ``d``."""
    return F.floor((F.unix_date(d) + WEEK_OFFSET) / 7).cast("int")


def week_start(key: Column) -> Column:
    """The Saturday that begins week ``key``."""
    return F.date_from_unix_date((key * 7 - WEEK_OFFSET).cast("int"))


def week_of_year(d: Column) -> Column:
    """Week of year 0-52 of the Saturday on or before ``d``."""
    start = week_start(week_key(d))
    return F.least(F.lit(52), F.floor((F.dayofyear(start) - 1) / 7).cast("int"))


def hydro_year(d: Column) -> Column:
    """October to September year, labelled by the year it starts in."""
    return F.year(d) - F.when(F.month(d) < 10, 1).otherwise(0)


def month_key(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def day_label(day_of_year: Column) -> Column:
    """Day of year to ``dd Mon`` in a year without a leap day, halves rounded to even."""
    offset = F.bround(day_of_year).cast("int") - 1
    return F.date_format(F.date_add(F.lit("2001-01-01").cast("date"), offset), "dd MMM")


def span_label(first: Column, last: Column) -> Column:
    return F.concat_ws("-", F.year(first).cast("string"), F.year(last).cast("string"))


def date_of(year: Column, month: Column, day: Column) -> Column:
    """Date from parts; null where the day does not exist (29 February)."""
    return F.try_to_date(F.concat_ws("-", year.cast("string"), month.cast("string"), day.cast("string")), "yyyy-M-d")


def is_trading_day(d: Column) -> Column:
    """The market is closed on Fridays."""
    return F.weekday(d) != FRIDAY
