"""Number expressions. Two comma rules live side by side: see parse_number and parse_number_review."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a number looks like; also keeps out NaN, infinities and type suffixes, which a cast would take.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def guarded(c: Column) -> Column:
    """A finite double, or null."""
    value = F.when(c.rlike(NUMBER), c.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def parse_number(c: Column) -> Column:
    """Percent signs and spaces go; a lone comma is a decimal point, commas beside a point are separators."""
    bare = F.regexp_replace(c, r"[%\s]", "")
    return guarded(F.when(F.contains(bare, F.lit(".")), F.replace(bare, F.lit(","), F.lit(""))).otherwise(F.replace(bare, F.lit(","), F.lit("."))))


def parse_number_review(c: Column) -> Column:
    """Percent signs, spaces and every comma go; 0 where nothing is left."""
    return F.coalesce(guarded(F.regexp_replace(c, r"[%\s,]", "")), F.lit(0.0))


def parse_hours(c: Column) -> Column:
    """Hours of the first 'HH:MM - HH:MM' in the text (past midnight if the end is before the start), or of a plain number.

    An hour over 23 or a minute over 59 gives null. A comma beside a point stays, so that such a text gives null.
    """
    shift = r"(\d{1,2}):(\d{2})\s*[-–—]\s*(\d{1,2}):(\d{2})"
    h1, m1, h2, m2 = (F.regexp_extract(c, shift, k).try_cast("int") for k in (1, 2, 3, 4))
    clock = F.when((h1 <= 23) & (h2 <= 23) & (m1 <= 59) & (m2 <= 59), F.pmod((h2 * 60 + m2) - (h1 * 60 + m1), F.lit(1440)) / 60)
    bare = F.trim(c)
    number = guarded(F.when(F.contains(bare, F.lit(".")), bare).otherwise(F.replace(bare, F.lit(","), F.lit("."))))
    return F.when(c.rlike(shift), clock).otherwise(F.when(number >= 0, number))


def parse_bool(c: Column, default: bool | None = None) -> Column:
    word = F.lower(F.trim(c))
    return F.when(word.isin("true", "1", "yes", "on"), True).when(word.isin("false", "0", "no", "off"), False).otherwise(F.lit(default).cast("boolean"))


def hidden(flag: Column) -> Column:
    """Only a flag that says no hides; a missing one doesn't."""
    return F.coalesce(F.lower(F.trim(flag)).isin("false", "0", "off", "no"), F.lit(False))


def parse_revision(c: Column) -> Column:
    return F.greatest(F.lit(0), F.coalesce(c.try_cast("int"), F.lit(0)))


def size_kb(n: Column) -> Column:
    return F.round(n / 1024, 1)


def safe_ratio(a: Column, b: Column, times: float = 1.0) -> Column:
    """a * times / b to 2 places; 0 where b is 0 or null."""
    return F.when(F.coalesce(b, F.lit(0.0)) == 0, 0.0).otherwise(F.round(a * times / b, 2))


def percent_text(c: Column) -> Column:
    return F.format_string("%.1f%%", c)
