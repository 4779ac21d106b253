"""Tables that grow: archives, drafts, partitions, array documents; revisions and weeks as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query, table
from ..sources.keyed import KeyedTable
from ..sources.scratch import folder
from ..streaming import revisions as streams


def _path(spark, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def _drafts(spark, sf_dir) -> list[DataFrame]:
    """Events of low and of high value: what comes first and what comes later, as (draft_id, saved, status)."""
    events = table(spark, sf_dir, "events")
    draft = F.concat_ws("-", "event_type", "user_id").alias("draft_id")
    return [events.where(side).select(draft, F.col("event_id").alias("saved"), F.lit(status).alias("status")) for side, status in ((F.col("value") < 60, "early"), (F.col("value") >= 60, "late"))]


@query("SELECT event_id, CASE WHEN value < 60 THEN 'early' ELSE 'late' END AS status FROM events")
def snk01_archive(spark, sf_dir):
    """Records once written stay: all events are sent again, and only those that the table lacks are added."""
    store = KeyedTable(spark, _path(spark, "archive"), "event_id long, status string", ["event_id"])
    events = table(spark, sf_dir, "events").select("event_id", "value")
    store.insert_absent(events.where("value < 60").select("event_id", F.lit("early").alias("status")), ["status"])
    store.insert_absent(events.select("event_id", F.lit("late").alias("status")), ["status"])
    return store.read()


@query("""SELECT event_type, CAST(ts AS DATE) AS date, event_id, CASE WHEN value >= 99 THEN 1000 + row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE), value >= 99 ORDER BY event_id)
    ELSE row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE), value >= 99 ORDER BY value >= 50, event_id) END AS revision FROM events""")
def snk01_writers_revision(spark, sf_dir):
    """Records get the next revision of their type and day, in two writes; those that come with one of their own are a series of theirs (own)."""
    store = KeyedTable(spark, _path(spark, "records"), "event_type string, date date, own boolean, event_id long, revision long", ["event_type", "date", "own"])
    day = Window.partitionBy("event_type", "date").orderBy("event_id")
    events = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("date"), (F.col("value") >= 99).alias("own"), "event_id", "value")
    for side in (F.coalesce(F.col("value") < 50, F.lit(True)), (F.col("value") >= 50) & ~F.col("own")):
        store.archive(events.where(side).drop("value").withColumn("revision", F.lit(None).cast("long")), "revision", ["event_id"])
    store.archive(events.where("own").drop("value").withColumn("revision", (F.row_number().over(day) + 1000).cast("long")), "revision", ["event_id"])
    return store.read().drop("own")


DRAFTS_SQL = """SELECT event_type || '-' || user_id AS draft_id, max(event_id) AS saved, CASE WHEN arg_max(value, event_id) < 60 THEN 'early' ELSE 'late' END AS status FROM events GROUP BY ALL"""
DRAFTS = "draft_id string, saved long, status string"


@query(DRAFTS_SQL)
def snk05_drafts(spark, sf_dir):
    """Each save takes the place of the one before."""
    store = KeyedTable(spark, _path(spark, "drafts"), DRAFTS, ["draft_id"])
    for part in _drafts(spark, sf_dir):
        store.upsert(part, ["saved"])
    return store.read()


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def snk07_removed(spark, sf_dir):
    """Orders written to a table, then those with a returned line removed from it."""
    store = KeyedTable(spark, _path(spark, "orders"), "o_orderkey long, o_custkey long", ["o_orderkey"])
    store.upsert(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"])
    store.delete(table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")))
    store.vacuum(keep=1, grace_seconds=0)
    return store.read()


@query("SELECT o_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity < 10")
def src02_lookup(spark, sf_dir):
    """Records looked up by owner and id: each wanted pair reads its owner's folder and the files that may hold its id."""
    path = _path(spark, "owners")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    orders.repartition("o_orderpriority").sortWithinPartitions("o_orderkey").write.partitionBy("o_orderpriority").parquet(path)
    owner = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("owner"))
    wanted = table(spark, sf_dir, "lineitem").where("l_quantity < 10").select("l_orderkey", "l_linenumber").join(owner, "l_orderkey")
    stored = spark.read.schema("o_orderkey long, o_custkey long, o_orderpriority string").parquet(path)
    found = wanted.join(stored, (F.col("owner") == F.col("o_orderpriority")) & (F.col("l_orderkey") == F.col("o_orderkey")))
    return found.select("o_orderkey", "l_linenumber", "o_custkey")


@query("SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def src09_array_rows(spark, sf_dir):
    """One document, a JSON array, for each conversation; rows of the arrays' objects."""
    path = _path(spark, "arrays")
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(turns).alias("doc")).select(F.to_json(F.struct("conv_id", "doc"))).write.text(path)
    rows = spark.read.schema("conv_id long, doc string").json(path)
    each = rows.select("conv_id", F.inline(F.from_json("doc", "array<struct<turn:long,role:string,text:string>>")))
    return each.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"))


def _stream(spark, sf_dir, *parts: DataFrame) -> DataFrame:
    """The parts as files of a stream, in this order."""
    path = _path(spark, "stream")
    for part in parts:
        part.write.mode("append").parquet(path)
    return spark.readStream.schema(parts[0].schema).parquet(path)


@query(DRAFTS_SQL)
def stm01_late_revisions(spark, sf_dir):
    """Batches of a stream upserted by key; a late revision takes the place of an earlier one."""
    store = KeyedTable(spark, _path(spark, "upserts"), DRAFTS, ["draft_id"])
    streams.upsert_stream(_stream(spark, sf_dir, *_drafts(spark, sf_dir)), store, ["saved"], _path(spark, "offsets")).awaitTermination()
    return store.read()


@query("SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type, count(*) AS n FROM events GROUP BY ALL")
def stm04_weekly_stream(spark, sf_dir):
    """Weeks counted in event time, each batch's changed weeks written; readers take the largest count of a week."""
    path, offsets = _path(spark, "weeks"), _path(spark, "offsets")
    counts = streams.weekly_counts(_stream(spark, sf_dir, table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp"), "event_type")), "ts", ["event_type"], late="60 days")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", offsets).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema("week date, event_type string, n long").parquet(path)
    return rows.groupBy("week", "event_type").agg(F.max("n").alias("n"))
