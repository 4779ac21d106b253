"""Rows with the same key, brought together in bounded pieces.

A key with more than `chunk` rows is cut into chunks, and each pair of its chunks becomes a group of its
own: no row is dropped, and no task gets more than two chunks of one key at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Rows of cut keys up to which they are broadcast (some 3 MB); beyond, a join by key.
BROADCAST_ROWS = 100_000


def dealt(rows: DataFrame, keys: list[str], node: str, chunk: int) -> DataFrame:
    """rows with first, second (chunk numbers) and side (0: this row is of the first), dealt and sorted by group."""
    large = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > chunk)
    large = written(large.select(*keys, F.ceil(F.col("__n") / chunk).cast("int").alias("__cut")), "large")
    n = large.count()
    if n:
        rows = rows.join(F.broadcast(large) if n <= BROADCAST_ROWS else large, keys, "left")
        return crossed(rows.withColumn("__cut", F.coalesce("__cut", F.lit(1))), keys, node)
    return by_group(rows.withColumns({"first": F.lit(0), "second": F.lit(0), "side": F.lit(0)}), keys, node)


def crossed(rows: DataFrame, keys: list[str], node: str) -> DataFrame:
    """dealt for keys whose number of chunks is each row's __cut."""
    rows = rows.withColumn("__own", F.pmod(F.xxhash64(node), F.col("__cut")).cast("int"))
    rows = rows.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__cut") - 1)))
    rows = rows.withColumn("first", F.least("__own", "__other")).withColumn("second", F.greatest("__own", "__other"))
    rows = rows.withColumn("side", F.when(F.col("__own") == F.col("first"), 0).otherwise(1)).drop("__cut", "__own", "__other")
    return by_group(rows, keys, node)


def by_group(rows: DataFrame, keys: list[str], node: str) -> DataFrame:
    group = [*keys, "first", "second"]
    return rows.repartition(*group).sortWithinPartitions(*group, "side", node)


def map_groups(rows: DataFrame, group: list[str], run: Callable[[pa.Table, np.ndarray], pa.Table | None], schema: str, about: int = 1 << 15) -> DataFrame:
    """run on some `about` rows at a time of sorted rows, cut between groups, with the first row of each group (and the end)."""

    def edges(table: pa.Table) -> np.ndarray:
        new = np.zeros(max(0, table.num_rows - 1), bool)
        for name in group:
            column = table.column(name).to_numpy()
            new |= column[1:] != column[:-1]
        return np.concatenate([[0], np.flatnonzero(new) + 1, [table.num_rows]])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= about:
                table = pa.Table.from_batches(held)
                cuts = edges(table)
                done = int(cuts[-2])
                if done and (out := run(table.slice(0, done), cuts[:-1])) is not None:
                    yield from out.to_batches()
                rest = table.slice(done).combine_chunks()
                held, count = rest.to_batches(), rest.num_rows
        if count:
            table = pa.Table.from_batches(held)
            if (out := run(table, edges(table))) is not None:
                yield from out.to_batches()

    return rows.mapInArrow(each, schema)


def ranges(cuts: np.ndarray, first: np.ndarray, second: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the rows [low, high) of its group that it is to be held against, so that each pair comes once."""
    n = int(cuts[-1])
    sizes = np.diff(cuts)
    high = np.repeat(cuts[1:], sizes)
    low = np.arange(1, n + 1)
    crossed = first != second
    if crossed.any():
        ones = np.add.reduceat((side == 1).astype(np.int64), cuts[:-1])
        low = np.where(crossed, high - np.repeat(ones, sizes), low)
        low = np.where(crossed & (side == 1), high, low)
    return low, high


class Forest:
    """Labels of rows, joined by links; the smallest row number is a component's label."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Joins a[i] and b[i]; returns those of these links that span what was joined."""
        spanning = [(a[:0], b[:0])]
        while len(a):
            x, y = self.label[a], self.label[b]
            differ = x != y
            if not differ.any():
                break
            a, b = a[differ], b[differ]
            low, high = np.minimum(x, y)[differ], np.maximum(x, y)[differ]
            parent = np.arange(len(self.label))
            np.minimum.at(parent, high, low)
            used = np.flatnonzero(parent[high] == low)
            used = used[np.unique(high[used], return_index=True)[1]]
            spanning.append((a[used], b[used]))
            while not np.array_equal(up := parent[parent], parent):
                parent = up
            self.label = parent[self.label]
        return np.concatenate([s[0] for s in spanning]), np.concatenate([s[1] for s in spanning])
