"""Numeric expressions: parsing, rounding and numeric text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(col: Column) -> Column:
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) != float("inf"))


def parse_measure(col: Column) -> Column:
    """Trimmed text as a finite double; blank or unusable text becomes null."""
    value = F.trim(col).try_cast("double")
    return F.when(finite(value), value)


def bad_measure(col: Column) -> Column:
    """True for text that is neither blank nor a finite number."""
    return F.coalesce(F.trim(col) != "", F.lit(False)) & parse_measure(col).isNull()


def percent_one_decimal(part: Column, whole: Column) -> Column:
    """Share in percent, one decimal, halves rounded up; 0 when the whole is 0."""
    return F.when(whole != 0, F.floor(part / whole * 100 * 10 + 0.5) / 10).otherwise(F.lit(0.0))


def clamp_confidence(col: Column) -> Column:
    """Confidence limited to [0, 1]; a missing one is 0.7."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(col.cast("double"), F.lit(0.7))))


def numeric_text(col: Column) -> Column:
    """Numeric text in one spelling: decimal dot, no thousands commas, no trailing zeros."""
    out = F.replace(F.lower(col), F.lit("·"), F.lit("."))
    out = F.regexp_replace(out, r"(\d),(?=\d{3}(\D|$))", "$1")
    out = F.regexp_replace(out, r"(\d+\.\d*?)0+(?=\D|$)", "$1")
    return F.regexp_replace(out, r"(\d+)\.(?=\D|$)", "$1")


def text_has_value(normalised: Column, value: Column) -> Column:
    """Whether text in ``numeric_text`` spelling states a value; a blank value never matches."""
    return F.coalesce((F.trim(value) != "") & F.contains(normalised, numeric_text(F.trim(value))), F.lit(False))


def caption_has_value(caption: Column, value: Column) -> Column:
    return text_has_value(numeric_text(caption), value)


def ratio(part: Column, whole: Column, empty: float) -> Column:
    """``part / whole``, or ``empty`` when there is nothing to divide by."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def fixed(value: Column, places: Column | int) -> Column:
    """Text with a fixed number of decimal places, halves rounded away from zero, no grouping."""
    count = F.lit(places) if isinstance(places, int) else places
    return F.call_function("format_string", F.concat(F.lit("%."), count.cast("string"), F.lit("f")), value.cast("double"))
