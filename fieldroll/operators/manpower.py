"""People, headcounts and man-hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_text


def person_key(name: Column, category: Column, position: Column) -> Column:
    """Named people are one by normalised name; rows without a name never merge."""
    named = F.nullif(norm_text(name), F.lit(""))
    return F.coalesce(F.concat(F.lit("n:"), named), F.concat(F.lit("a:"), category, F.lit(":"), position.cast("string")))


def people(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, category and person: the longest hours and the first role that isn't blank. rows: keys, category, person_key, row_pos, role, hours."""
    role = F.nullif(F.trim("role"), F.lit(""))
    return rows.groupBy(*keys, "category", "person_key").agg(
        F.max("hours").alias("hours"),
        F.min_by(role, F.when(role.isNotNull(), F.col("row_pos"))).alias("role"),
    )


def combined(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and person, in one aggregation of rows (keys, category, person_key, row_pos, role, hours).

    Hours are the longest of each kind; a shared person's direct hours are the larger of both kinds. The role
    is the first that isn't blank of the direct rows, if there are any, else of the indirect ones.
    """
    direct, role = F.col("category") == "direct", F.nullif(F.trim("role"), F.lit(""))
    first = lambda kind: F.min_by(role, F.when(role.isNotNull() & kind, F.col("row_pos")))
    wide = rows.groupBy(*keys, "person_key").agg(
        F.bool_or(direct).alias("is_direct"),
        F.bool_or(~direct).alias("is_indirect"),
        F.max(F.when(~direct, F.col("hours"))).alias("indirect_hours"),
        F.max("hours").alias("hours"),
        first(direct).alias("direct_role"),
        first(~direct).alias("indirect_role"),
    )
    role = F.when(F.col("is_direct"), F.col("direct_role")).otherwise(F.col("indirect_role"))
    return wide.select(*keys, "person_key", "is_direct", "is_indirect", F.when(F.col("is_direct"), F.col("hours")).alias("direct_hours"), "indirect_hours", "hours", role.alias("role"))


def daily(combined: DataFrame, keys: list[str]) -> DataFrame:
    """Headcounts and hours (to 2 places) of each day; a null person_key is nobody, so that a day may be empty."""
    hours = lambda c: F.coalesce(F.round(F.sum(c), 2), F.lit(0.0))
    return combined.groupBy(*keys).agg(
        F.count_if("is_direct").alias("direct_headcount"),
        F.count_if("is_indirect").alias("indirect_headcount"),
        F.count("person_key").alias("total_headcount"),
        hours("direct_hours").alias("direct_man_hours"),
        hours("indirect_hours").alias("indirect_man_hours"),
        hours("hours").alias("total_man_hours"),
        F.count_if(F.col("person_key").isNotNull() & F.col("hours").isNull()).alias("unparsed_hours_count"),
    )


def totals(days: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Sums of the days' rounded values, and the peak."""
    return days.groupBy(*keys).agg(
        F.coalesce(F.sum("total_headcount"), F.lit(0)).alias("total_person_days"),
        F.coalesce(F.round(F.sum("direct_man_hours"), 2), F.lit(0.0)).alias("direct_man_hours"),
        F.coalesce(F.round(F.sum("indirect_man_hours"), 2), F.lit(0.0)).alias("indirect_man_hours"),
        F.coalesce(F.round(F.sum("total_man_hours"), 2), F.lit(0.0)).alias("total_man_hours"),
        F.coalesce(F.max("total_headcount"), F.lit(0)).alias("peak_headcount"),
        F.coalesce(F.sum("unparsed_hours_count"), F.lit(0)).alias("unparsed_hours_count"),
    )


def roles(combined: DataFrame, order: list[str], keys: list[str] = ()) -> DataFrame:
    """Person-days and hours of each role; the label is the first one seen by order."""
    label = F.coalesce(F.nullif(F.trim("role"), F.lit("")), F.lit("Unspecified"))
    own = combined.withColumns({"__label": label, "role_key": norm_text(label)})
    return own.groupBy(*keys, "role_key").agg(
        F.min_by("__label", F.struct(*order, "__label")).alias("role"),
        F.count("*").alias("person_days"),
        F.coalesce(F.round(F.sum("hours"), 2), F.lit(0.0)).alias("man_hours"),
        F.count_if(F.col("hours").isNull()).alias("unparsed_hours_count"),
    )
