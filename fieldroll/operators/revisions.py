"""Which of several records counts: arg-max, losers, next numbers, first per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is largest by order. One hash aggregation with partial results, no sort of rows."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__best"))
    return best.select(*keys, *(F.col(f"__best.`{c}`").alias(c) for c in rest))


def superseded(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows that latest leaves out."""
    best = df.groupBy(*keys).agg(F.max(F.struct(*order)).alias("__best"))
    return df.join(best, keys).where(F.struct(*order) != F.col("__best")).select(*df.columns)


def first_per_key(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key by order, which makes the survivor certain."""
    named = [k.alias(f"__k{i}") for i, k in enumerate(keys)]
    best = df.select(*named, F.struct(*order, *(c for c in df.columns if c not in order)).alias("__row"))
    best = best.groupBy(*(f"__k{i}" for i in range(len(keys)))).agg(F.min("__row").alias("__row"))
    return best.select(*(F.col(f"__row.`{c}`").alias(c) for c in df.columns))


def next_number(df: DataFrame, keys: list[str], number: Column, name: str = "next_revision") -> DataFrame:
    return df.groupBy(*keys).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias(name))


def newest(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each key by order."""
    own = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(own)).where(F.col("__n") <= most).drop("__n")
