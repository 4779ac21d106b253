"""Calendars and what of them is covered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def calendar(reports: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """Every day from each key's first to its last."""
    ends = reports.where(F.col(date).isNotNull()).groupBy(*keys).agg(F.min(date).alias("__first"), F.max(date).alias("__last"))
    return ends.select(*keys, F.explode(F.sequence("__first", "__last")).alias(date))


def covered(reports: DataFrame, start: str, end: str, keys: list[str], date: str = "date") -> DataFrame:
    return reports.where(F.col(date).between(start, end)).select(*keys, date).distinct()


def missing_dates(reports: DataFrame, start: str, end: str, keys: list[str], date: str = "date") -> DataFrame:
    """Days of the period that a key has no report for. The spine is exploded beside each key, so no cross join is planned."""
    own = reports.select(*keys).distinct()
    spine = own.select(*keys, F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias(date))
    return spine.join(covered(reports, start, end, keys, date), [*keys, date], "left_anti")


def extra_dates(reports: DataFrame, start: str, end: str, keys: list[str], date: str = "date") -> DataFrame:
    """Reported days that lie outside the period."""
    return reports.where(~F.col(date).between(start, end)).select(*keys, date).distinct()


def coverage(reports: DataFrame, start: str, end: str, keys: list[str], date: str = "date") -> DataFrame:
    """For each key: covered and missing days, superseded reports, duplicate days, the last day, whether it is partial."""
    per_day = reports.where(F.col(date).between(start, end)).groupBy(*keys, date).agg(F.count("*").alias("n"))
    days = F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date")) + 1
    return per_day.groupBy(*keys).agg(
        F.count("*").alias("covered_days"),
        (days - F.count("*")).cast("long").alias("missing_days"),
        F.sum(F.col("n") - 1).alias("superseded_count"),
        F.count_if(F.col("n") > 1).alias("duplicate_days"),
        F.max(date).alias("last_report_date"),
        (F.count("*") < days).alias("is_partial"),
    )
