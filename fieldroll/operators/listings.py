"""Listings: runners-up, consecutive numbers, people and values as lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def with_margin(rows: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """The best row of each key (ties: the smallest `tie`) and its margin over the next score; null without a runner-up."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(tie))
    own = rows.withColumn("margin", F.col(score) - F.lead(score).over(order)).withColumn("__n", F.row_number().over(order))
    return own.where("__n = 1").drop("__n")


def renumbered(rows: DataFrame, keys: list[str], position: str, present: Column) -> DataFrame:
    """Rows that are present, with consecutive numbers from 1 in the order of position."""
    order = Window.partitionBy(*keys).orderBy(position)
    return rows.where(present).withColumn("number", F.row_number().over(order))


def placed(rows: DataFrame, keys: list[str], order: list[str], name: str = "place") -> DataFrame:
    """rows with their place, from 1, in the order of their key, in two levels: no task holds all rows of a key.

    Ranges of (keys, order) are written with their number; how many rows of a key the ranges before hold, one number a
    range and key, gives the rest. order should tell a key's rows apart; equal ones get either place.
    """
    at = [*keys, *order]
    ranges = written(rows.repartitionByRange(*at).sortWithinPartitions(*at).withColumn("__range", F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranges.groupBy(*keys, "__range").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    before = counts.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__range").alias("__of"), "__before")
    same = F.col("__range") == F.col("__of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    inside = Window.partitionBy("__range", *keys).orderBy(*order)
    place = F.row_number().over(inside) + F.col("__before")
    return ranges.join(before, same).withColumn(name, place).drop("__range", "__of", "__before", *(f"__{k}" for k in keys))


def listed(rows: DataFrame, keys: list[str], name: str, most: int | None = None) -> DataFrame:
    """Distinct values of each key as a sorted list; with `most`, the first of them and how many more there are.

    With `most` a key's values are counted and its first ones found apart, so that no list is longer than that.
    """
    if most is None:
        return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(name)).alias(name))
    values = rows.select(*keys, name).distinct()
    counts = values.groupBy(*keys).agg(F.count(name).alias("__n")).withColumn(name, F.lit(None).cast(values.schema[name].dataType))
    first = Window.partitionBy(*keys).orderBy(name)
    first = values.where(F.col(name).isNotNull()).withColumn("__place", F.row_number().over(first)).where(F.col("__place") <= most).drop("__place")
    both = counts.unionByName(first.withColumn("__n", F.lit(None).cast("long"))).groupBy(*keys)
    own = both.agg(F.max("__n").alias("__n"), F.array_sort(F.collect_list(name)).alias(name))
    return own.select(*keys, name, F.greatest(F.col("__n") - most, F.lit(0)).cast("int").alias("more"))


def section_order(given: Column, aliases: dict[str, str], default: tuple[str, ...]) -> Column:
    """The given sections by their names or aliases, unknown ones left out, each once, then what the default order has beside them."""
    known = F.create_map(*(F.lit(x) for pair in ({d: d for d in default} | aliases).items() for x in pair))
    named = F.array_compact(F.transform(F.coalesce(given, F.array().cast("array<string>")), lambda x: F.try_element_at(known, F.lower(F.trim(x)))))
    return F.array_union(F.array_distinct(named), F.array(*map(F.lit, default)))


def as_list(value: Column) -> Column:
    """A VARIANT as an array of them: an array as it is, null and an empty text as none, any other value as the only one."""
    none = value.isNull() | F.is_variant_null(value) | F.coalesce(F.try_variant_get(value, "$", "string") == "", F.lit(False))
    listed = F.try_variant_get(value, "$", "array<variant>")
    return F.when(none, F.array().cast("array<variant>")).otherwise(F.coalesce(listed, F.array(value)))
