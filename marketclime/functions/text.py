"""Text clean-up, parsing and unit conversion as native column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Character sets and lookup tables.
ARABIC_INDIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
ASCII_DIGITS = "0123456789"
BIDI_MARKS = "[\u200b-\u200f\u202a-\u202e\u2066-\u2069]"
ARABIC_DIACRITICS = "[\u064b-\u0652\u0670\u0653-\u0655]"
TATWEEL = "\u0640"
LETTER_FOLDS = {
    "أ": "ا",
    "إ": "ا",
    "آ": "ا",
    "ٱ": "ا",
    "ى": "ي",
    "ة": "ه",
    "ؤ": "و",
    "ئ": "ي",
}
MONTH_LABELS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# every character that Unicode or ASCII separators count as white space
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)
_DECIMAL_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def strip(c: Column) -> Column:
    """Remove leading and trailing Unicode white space (``trim`` only knows blanks)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def clean_cell(c: Column) -> Column:
    """Arabic-Indic digits to ASCII, directional and zero-width marks dropped, stripped."""
    return strip(F.regexp_replace(F.translate(c, ARABIC_INDIC_DIGITS, ASCII_DIGITS), BIDI_MARKS, ""))


def plain_number(c: Column) -> Column:
    """Decimal text to double; anything else, including nan and inf, is null."""
    return F.regexp_extract(strip(c), _DECIMAL_TEXT, 0).try_cast("double")


def number_of(cleaned: Column) -> Column:
    """Cleaned cell text to double, thousands separators removed."""
    return plain_number(F.replace(cleaned, F.lit(","), F.lit("")))


def to_number(c: Column) -> Column:
    """Published cell text to double."""
    return number_of(clean_cell(c))


def iso_date(c: Column) -> Column:
    """``yyyy-M-d`` text to date, else null."""
    return F.try_to_date(c, "yyyy-M-d")


def date_of_text(cleaned: Column) -> Column:
    """Cleaned date text to date: day-first with dashes, ISO, day-first with slashes."""
    return F.coalesce(
        F.try_to_date(cleaned, "d-M-yyyy"),
        F.try_to_date(cleaned, "yyyy-M-d"),
        F.try_to_date(cleaned, "d/M/yyyy"),
    )


def to_date_any(c: Column) -> Column:
    """Published date text to date."""
    return date_of_text(clean_cell(c))


def fold_arabic(c: Column) -> Column:
    """Spelling folds that carry no meaning; expects NFKC text (see :func:`nfkc`)."""
    c = F.regexp_replace(c, BIDI_MARKS, "")
    c = F.regexp_replace(c, ARABIC_DIACRITICS, "")
    c = F.replace(c, F.lit(TATWEEL), F.lit(""))
    c = F.translate(c, "".join(LETTER_FOLDS), "".join(LETTER_FOLDS.values()))
    return strip(F.regexp_replace(c, f"[{WHITE_SPACE}]+", " "))


def nfkc():
    """Vectorised NFKC. Spark has no such built-in; apply it to distinct names only."""

    def normalise(texts: pd.Series) -> pd.Series:
        return texts.str.normalize("NFKC")

    return F.pandas_udf(normalise, T.StringType())


def month_numbers(c: Column) -> Column:
    """``"Oct/Nov"`` or ``"April; December"`` to an array of distinct month numbers, in order."""
    lookup = F.create_map(*[x for i, m in enumerate(MONTH_LABELS, 1) for x in (F.lit(m.lower()), F.lit(i))])
    numbers = F.transform(
        F.split(c, "[;,/]"),
        lambda part: F.try_element_at(lookup, F.substring(F.lower(strip(part)), 1, 3)),
    )
    return F.array_distinct(F.filter(numbers, lambda m: m.isNotNull()))


def month_label(month: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(m) for m in MONTH_LABELS]), month.cast("int"))


def kg_per_dunum(value: Column, unit: Column) -> Column:
    """Yield per hectare in any published unit to kg per dunum (0.1 ha); unknown units give null."""
    u = F.replace(F.lower(unit), F.lit(" "), F.lit(""))
    return (
        F.when(u.contains("100g/ha") | u.contains("hg/ha"), value * 0.1 / 10)
        .when(u.contains("kg/ha"), value / 10)
        .when(u.contains("t/ha") | u.contains("tonnes/ha"), value * 100)
    )
