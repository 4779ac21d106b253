"""Running totals over a whole table in a global order, in two levels.

Rows are range-partitioned by the order and written with the number of their range; the ranges' sums, one
row a range, give each range's offset, and a window inside each range gives the rest. No task sees more
than a range of rows, however few keys there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def ranged(rows: DataFrame, order: list[Column], name: str = "ranged") -> DataFrame:
    """rows in global order with __range, from a table in the shared folder; rows should come from a table too, since ranges are sampled first."""
    return written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id()), name)


def offsets(rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """__range and, of each sum, what is in all ranges before it: one row a range."""
    own = rows.groupBy("__range").agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return own.select("__range", *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums))


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], name: str = "ranged") -> DataFrame:
    """rows with a column for each of sums: its total over the rows up to and including this one.

    order should tell rows apart; rows that are equal in it count in any order.
    """
    rows = ranged(rows, order, name)
    before = offsets(rows, sums).select("__range", *(F.col(n).alias(f"__{n}") for n in sums))
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = {n: F.sum(c).over(inside) + F.col(f"__{n}") for n, c in sums.items()}
    return rows.join(F.broadcast(before), "__range").withColumns(totals).drop("__range", *(f"__{n}" for n in sums))
