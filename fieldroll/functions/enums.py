"""Names from free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _word(c: Column) -> Column:
    return F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit("-"))


def report_type(c: Column) -> Column:
    return F.when(_word(c).isin("weekly", "week", "wtd", "week-to-date", "week to date"), "weekly").otherwise("monthly")


def report_mode(kind: Column, c: Column) -> Column:
    """wtd, mtd, draft or final; what the kind doesn't allow is its to-date mode."""
    weekly = report_type(kind) == "weekly"
    word = _word(c)
    own = F.when(word.isin("month-to-date", "month to date"), "mtd").when(word.isin("week-to-date", "week to date"), "wtd").otherwise(word)
    to_date = F.when(weekly, "wtd").otherwise("mtd")
    return F.when(own.isin("draft", "final") | (own == to_date), own).otherwise(to_date)


def status(c: Column, kind: Column | None = None) -> Column:
    """DRAFT unless the text says otherwise; a partial period is WTD in a weekly report, MTD in others."""
    word = _word(c)
    weekly = F.lit(False) if kind is None else report_type(kind) == "weekly"
    return (
        F.when(word.isin("final", "issued", "approved"), "FINAL")
        .when(word.isin("wtd", "week-to-date", "week to date"), "WTD")
        .when(word.isin("mtd", "month-to-date", "month to date", "partial", "to-date", "to date"), F.when(weekly, "WTD").otherwise("MTD"))
        .otherwise("DRAFT")
    )


#: What an activity's name holds, in the order in which it is looked for, and its class.
BADGES = {"generate": "primary", "login": "success", "logout": "secondary", "draft": "info", "delete": "danger", "letter": "warning"}


def badge(c: Column) -> Column:
    """A class of activity by what its name holds."""
    return F.coalesce(*(F.when(F.contains(c, F.lit(part)), name) for part, name in BADGES.items()), F.lit("light"))


def chosen(key: Column, names: dict[str, str], default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in names.items() for x in p)), key), F.lit(default))


def field_confidence(method: Column) -> Column:
    """Fixed values by how a field was found; null: it wasn't."""
    return F.when(method.isNull(), 0.0).when(method.isin("label", "master"), 1.0).when(method == "unique", 0.8).otherwise(0.7)


def overall_confidence(date: Column, day: Column, project_no: Column, title: Column, complete: Column) -> Column:
    """Weights 2, 2, 2, 1; below .7 while something critical is missing."""
    mean = (2 * date + 2 * day + 2 * project_no + title) / 7
    return F.round(F.when(complete, mean).otherwise(F.least(mean, F.lit(0.69))), 4)
