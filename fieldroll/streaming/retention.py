"""Logs and drafts of which each key keeps the newest few, as a stream: a bounded ordered buffer a key, with timers.

The buffer holds `most` entries at most, of which none is older than `age` before the key's newest. A timer
drops what the watermark has left behind by `age`, and with the last entry the key's state. What goes out is
a key's whole buffer with a rising version, so that a table with a row a key takes it over as it is.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.keyed import KeyedTable
from .revisions import upsert_stream

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Newest(StatefulProcessor):
    """The newest entries of each key: rows of entry_at (microseconds), entry_id and entry_body (JSON)."""

    def __init__(self, keys: list[str], most: int, age: int | None):
        self.keys, self.most, self.age = keys, most, age

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getListState("entries", "at bigint, id bigint, body string")
        self.version = handle.getValueState("version", "n bigint")

    def _held(self) -> list[tuple[int, int, str]]:
        return [tuple(e) for e in self.entries.get()] if self.entries.exists() else []

    def _kept(self, key: tuple, entries: list[tuple[int, int, str]], since: int | None) -> pd.DataFrame:
        """Stores the newest of entries and sets the timer for the oldest; since: the time before which they have expired."""
        entries = sorted(set(entries), reverse=True)
        if self.age is not None and entries:
            since = max(x for x in (since, entries[0][0] - self.age) if x is not None)
        entries = [e for e in entries if since is None or e[0] >= since][: self.most]
        n = (self.version.get()[0] if self.version.exists() else 0) + 1
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if entries:
            self.entries.put(entries)
            self.version.update((n,))
            if self.age is not None:
                self.handle.registerTimer((entries[-1][0] + self.age) // 1000 + 1)
        else:
            self.entries.clear()
            self.version.clear()
        out = {k: [v] for k, v in zip(self.keys, key)}
        return pd.DataFrame(out | {"version": [n], "entries": [json.dumps(entries)]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        entries = self._held()
        for part in rows:
            entries += list(zip(part["entry_at"].tolist(), part["entry_id"].tolist(), part["entry_body"].tolist()))
            entries = sorted(set(entries), reverse=True)[: self.most]  # more than these never stay
        yield self._kept(key, entries, None)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._kept(key, self._held(), timerValues.getCurrentWatermarkInMs() * 1000 - self.age)

    def close(self) -> None:
        pass


@contextmanager
def rocks(spark: SparkSession):
    """The state store that such state needs, for queries that start in here."""
    old = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, old)


def newest(stream: DataFrame, keys: list[str], ts: str, id_: str, fields: list[str], most: int, age_days: float | None = None, late: str = "1 day") -> DataFrame:
    """keys, version and entries (array of at, id and fields, the newest first), for each key that a batch changes. Rows without a time are left out; equal ones count once."""
    own = stream.withWatermark(ts, late).where(F.col(ts).isNotNull()).select(*keys, ts, F.unix_micros(ts).alias("entry_at"), F.col(id_).cast("long").alias("entry_id"), F.to_json(F.struct(*fields)).alias("entry_body"))
    types = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", version bigint, entries string"
    age = None if age_days is None else int(age_days * 86_400_000_000)
    out = own.groupBy(*keys).transformWithStateInPandas(Newest(keys, most, age), schema, "Update", "EventTime")
    each = F.from_json("entries", "array<array<string>>")
    body = "struct<" + ",".join(f"{f}:{types[f]}" for f in fields) + ">"
    entry = lambda e: F.struct(F.timestamp_micros(e[0].cast("long")).alias("at"), e[1].cast("long").alias("id"), F.from_json(e[2], body).alias("row"))
    return out.select(*keys, "version", F.transform(each, entry).alias("entries"))


def keep_newest(stream: DataFrame, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """The stream of newest into a table with a row a key."""
    with rocks(stream.sparkSession):
        return upsert_stream(stream, table, ["version"], checkpoint)
