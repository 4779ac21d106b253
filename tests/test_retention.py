"""Streams that keep the newest entries of each key, stopped and started again."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldroll.sources.keyed import KeyedTable
from fieldroll.streaming import retention

ENTRIES = "user string, version long, entries array<struct<at:timestamp,id:long,row:struct<action:string>>>"


def fed(spark, tmp_path, parts, **how):
    """The table after the stream was run once for each part, each time started anew from its checkpoint."""
    store = KeyedTable(spark, str(tmp_path / "log"), ENTRIES, ["user"], buckets=2)
    source = str(tmp_path / "source")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(source)
        retention.keep_newest(retention.newest(stream, ["user"], "ts", "id", ["action"], **how), store, str(tmp_path / "offsets")).awaitTermination()
    return store


def kept(store):
    return {r.user: [(e.id, e.row.action) for e in r.entries] for r in store.read().collect()}


@pytest.mark.parametrize(("most", "age"), [(20, None), (19, 7)])
def test_same_as_batch_after_restarts(spark, tmp_path, sf_dir, most, age):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("u"), F.col("user_id") % 3).alias("user"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), F.col("event_type").alias("action"))
    parts = [events.where(F.col("id") % 3 == k) for k in (1, 0, 2)]
    store = fed(spark, tmp_path, parts, most=most, age_days=age, late="400 days")
    wanted = {}
    for r in sorted(events.collect(), key=lambda r: (r.ts, r.id), reverse=True):
        own = wanted.setdefault(r.user, [])
        if len(own) < most and (age is None or not own or own[0][0] - r.ts <= dt.timedelta(days=age)):
            own.append((r.ts, r.id, r.action))
    assert kept(store) == {u: [x[1:] for x in own] for u, own in wanted.items()}
    assert all(len(own) == most for own in wanted.values()) or age


def test_the_watermark_drops_old_entries(spark, tmp_path):
    at = lambda day: dt.datetime(2024, 1, 1) + dt.timedelta(days=day)
    schema = "user string, ts timestamp, id long, action string"
    parts = [[("a", at(0), 1, "x"), ("a", at(5), 2, None), ("b", at(1), 3, "z"), ("b", None, 9, "no"), ("b", at(1), 3, "z")], [("c", at(10), 4, "w")], [("c", at(11), 5, "w")]]
    store = fed(spark, tmp_path, [spark.createDataFrame(p, schema) for p in parts], most=19, age_days=7, late="0 days")
    assert kept(store) == {"a": [(2, None)], "b": [], "c": [(5, "w"), (4, "w")]}
