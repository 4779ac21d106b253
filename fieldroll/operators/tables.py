"""Keyed tables: upsert, overlay, retention, totals by set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .revisions import first_per_key, latest


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new over them, key by key."""
    rest = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*rest).alias("__old"))
    b = new.select(*keys, F.struct(*rest).alias("__new"))
    both = a.join(b, keys, "full_outer").withColumn("__row", F.coalesce("__new", "__old"))
    return both.select(*keys, *(F.col(f"__row.`{c}`").alias(c) for c in rest)).select(*old.columns)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and the rows of new whose keys it doesn't hold."""
    return old.unionByName(new.select(*old.columns).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def known_projects(rows: DataFrame, title: str, number: str, position: str) -> DataFrame:
    """Pairs of title and number, trimmed: the first of those that differ in case only; without blank and overlong ones (300, 150 characters)."""
    own = rows.select(F.trim(title).alias(title), F.trim(number).alias(number), position)
    own = own.where(F.length(title).between(1, 300) & F.length(number).between(1, 150))
    return first_per_key(own, [F.lower(title), F.lower(number)], [position])


def latest_context(rows: DataFrame, keys: list[str], order: list[str], defaults: dict[str, str]) -> DataFrame:
    """Each key's latest record's fields, with a default where one is null."""
    own = latest(rows, keys, order)
    return own.select(*keys, *(F.coalesce(c, F.lit(d)).alias(c) for c, d in defaults.items()))


def overlay(defaults: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Field by field: the stored value where there is one, else the default."""
    rest = [c for c in defaults.columns if c not in keys]
    a = defaults.select(*keys, *(F.col(c).alias(f"__d_{c}") for c in rest))
    both = stored.join(a, keys, "full_outer")
    return both.select(*keys, *(F.coalesce(c, f"__d_{c}").alias(c) for c in rest))


def without(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def counted(left: DataFrame, right: DataFrame, key: str, right_key: str, name: str) -> DataFrame:
    """left with the number of its rows in right, 0 where there is none. right is counted before the join."""
    counts = right.groupBy(F.col(right_key).alias("__k")).agg(F.count("*").alias(name))
    return left.join(counts, F.col(key) == F.col("__k"), "left").drop("__k").withColumn(name, F.coalesce(name, F.lit(0)))


def fill(rows: DataFrame, master: DataFrame, key: str, value: str) -> DataFrame:
    """Blank values filled from the master, and whether a value differs from the master's."""
    m = master.select(key, F.col(value).alias("__m"))
    own = F.nullif(F.trim(value), F.lit(""))
    return rows.join(m, key, "left").withColumns({value: F.coalesce(own, "__m"), "mismatch": F.coalesce(own != F.col("__m"), F.lit(False))}).drop("__m")


def latest_only(rows: DataFrame, keys: list[str], date: str) -> DataFrame:
    """The rows of each key's last date. The last date is aggregated first; no window over all rows."""
    if not keys:
        return rows.where(F.col(date) == rows.groupBy().agg(F.max(date)).scalar())
    last = rows.groupBy(*keys).agg(F.max(date).alias("__last"))
    return rows.join(last, keys).where(F.col(date) == F.col("__last")).drop("__last")


def any_filled(*columns: Column) -> Column:
    """Whether one of the trimmed fields is not empty."""
    return F.exists(F.array(*(F.coalesce(F.trim(c), F.lit("")) for c in columns)), lambda x: x != "")
