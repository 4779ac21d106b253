"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text

#: Month names that dates are written with, January to December.
MONTH_NAMES = (
    ("january", "januari", "jan"), ("february", "februari", "feb"), ("march", "maret", "mar"), ("april", "apr"), ("may", "mei"), ("june", "juni", "jun"),
    ("july", "juli", "jul"), ("august", "agustus", "aug", "agu"), ("september", "sep", "sept"), ("october", "oktober", "oct", "okt"), ("november", "nov"), ("december", "desember", "dec", "des"),
)
MONTHS = {name: number for number, names in enumerate(MONTH_NAMES, 1) for name in names}


def iso_date(c: Column) -> Column:
    """A strict YYYY-MM-DD, or null."""
    return F.when(F.trim(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(F.trim(c), "yyyy-MM-dd"))


def utc_timestamp(c: Column) -> Column:
    """ISO-8601 text as a timestamp; without an offset it is UTC (the session's zone)."""
    return F.trim(c).try_cast("timestamp")


def utc_text(c: Column) -> Column:
    return F.date_format(utc_timestamp(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _made(year: Column, month: Column, day: Column) -> Column:
    """The date of three texts of figures. Cast, not parsed by a pattern: that costs a formatter and, for no date, an exception each time."""
    return F.when(year.between("1900", "2200"), F.concat(year, F.lit("-"), month, F.lit("-"), day).try_cast("date"))


def iso_value(c: Column) -> Column:
    """date_value of a text that has the form of an ISO date."""
    return F.when(F.substring(c, 1, 4).between("1900", "2200"), c.try_cast("date"))


def _bound(value: Column, make) -> Column:
    """make(value), for which value is computed once, however often make uses it."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


#: The ways in which dates are written.
ISO = r"(\d{4})-(\d{2})-(\d{2})"
FIGURES = r"(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})"
DAY_FIRST = r"(\d{1,2})\s*[- /]\s*([A-Za-z]+)\s*[-, /]\s*(\d{4})"
MONTH_FIRST = r"([A-Za-z]+)\s+(\d{1,2})(?:st|nd|rd|th)?\s*,?\s+(\d{4})"


def _read(c: Column, whole: bool) -> Column:
    numbers = F.create_map(*(F.lit(x) for name, number in MONTHS.items() for x in (name, str(number))))
    edged = lambda pattern: f"^{pattern}$" if whole else rf"\b{pattern}\b"
    parts = lambda pattern: F.split(F.regexp_extract(c, edged(pattern), 0), "[^0-9A-Za-z]+")
    month = lambda name: F.try_element_at(numbers, F.lower(name))
    # Each pattern is searched once; its match is cut into day, month and year (a single empty text, if there is none).
    read = lambda pattern, make: _bound(parts(pattern), lambda p: F.when(F.size(p) >= 3, make(F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(p, F.lit(2)))))
    return F.coalesce(
        read(ISO, lambda year, m, day: _made(year, m, day)),
        read(FIGURES, lambda day, m, year: F.when((day.cast("int") > 12) | (m.cast("int") > 12), _made(year, m, day))),
        read(DAY_FIRST, lambda day, name, year: _made(year, month(name), day)),
        read(MONTH_FIRST, lambda name, day, year: _made(year, month(name), F.regexp_replace(day, "[a-z]+$", ""))),
    )


def _bare(c: Column) -> Column:
    return F.regexp_replace(clean_text(c), "^[.,]+|[.,]+$", "")


def any_date(c: Column) -> Column:
    """The date in a text: ISO; day, month and year in figures, unless both could be the month; 4 August 2026; August 4th, 2026. Else null."""
    return _read(c, False)


def date_value(c: Column) -> Column:
    """any_date where the text is nothing but the date."""
    return _read(_bare(c), True)


def date_problem(c: Column) -> Column:
    """Why date_value is null: ambiguous_numeric_date, invalid_date or unrecognized_date_format; null if it isn't."""
    v = _bare(c)
    part = lambda k: F.regexp_extract(v, f"^{FIGURES}$", k).try_cast("int")
    known = v.rlike("|".join(f"^{p}$" for p in (ISO, FIGURES, DAY_FIRST, MONTH_FIRST)))
    why = F.when((part(1) <= 12) & (part(2) <= 12), "ambiguous_numeric_date").when(known, "invalid_date").otherwise("unrecognized_date_format")
    return F.when(c.isNotNull() & _read(v, True).isNull(), why)


def week_start(c: Column) -> Column:
    """The Monday of the week."""
    return F.trunc(c, "week")


def period_problem(start: Column, end: Column, kind: Column, mode: Column) -> Column:
    """Why a period is not allowed; null if it is. Monthly: within a month. Weekly: from Monday, 7 days at most, and the whole week unless to date."""
    days = F.datediff(end, start) + 1
    weekly = (
        F.when(F.weekday(start) != 0, "start on Monday")
        .when(days > 7, "longer than 7 days")
        .when((mode != "wtd") & (days != 7), "Monday through Sunday")
    )
    monthly = F.when(F.trunc(start, "MM") != F.trunc(end, "MM"), "one calendar month")
    return F.when(end < start, "end before start").when(kind == "weekly", weekly).otherwise(monthly)


#: Months as letters show them.
LONG_MONTHS = ("Januari", "Februari", "Maret", "April", "Mei", "Juni", "Juli", "Agustus", "September", "Oktober", "November", "Desember")


def long_date(date: Column) -> Column:
    """4 Agustus 2026."""
    month = F.get(F.array(*map(F.lit, LONG_MONTHS)), F.month(date) - 1)
    return F.concat_ws(" ", F.day(date).cast("string"), month, F.year(date).cast("string"))


#: Fixed value: names of snapshots.
SNAPSHOT_NAME = r"^\d{8}_\d{6}\.json$"


def snapshot_time(name: Column) -> Column:
    """The time in a snapshot's name as it is shown; the name without its end, if it is no time."""
    stem = F.regexp_replace(name, r"\.json$", "")
    return F.coalesce(F.date_format(F.try_to_timestamp(stem, F.lit("yyyyMMdd_HHmmss")), "dd MMM yyyy HH:mm:ss"), stem)
