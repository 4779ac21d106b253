"""Folders and indexes: owners found by their folders, snapshots by their names, lists that grow at the front; lists from single values."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import listings as ls
from ..registry import query, table
from .stores import _path


@query("SELECT o_orderpriority AS owner, count(*) AS records FROM orders WHERE regexp_full_match(o_orderpriority, '[A-Za-z0-9._-]+') GROUP BY ALL")
def src03_owner_folders(spark, sf_dir):
    """Owners are what folders there are; those with unsafe names are left out, before anything of theirs is read."""
    path = _path(spark, "folders")
    table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("owner")).write.partitionBy("owner").parquet(path)
    return spark.read.parquet(path).where(F.col("owner").rlike("^[A-Za-z0-9._-]+$")).groupBy("owner").agg(F.count("*").alias("records"))


@query("""WITH n AS (SELECT user_id, event_id, CASE WHEN value >= 70 THEN strftime(ts, '%Y%m%d_%H%M%S') ELSE '20241399_000000' END || '.json' AS filename,
        CASE WHEN value >= 70 THEN strftime(ts, '%d %b %Y %H:%M:%S') ELSE '20241399_000000' END AS shown FROM events WHERE value >= 60)
    SELECT user_id, event_id, filename, shown, CAST(row_number() OVER (PARTITION BY user_id ORDER BY filename DESC, event_id DESC) AS INTEGER) AS place FROM n""")
def src11_snapshots(spark, sf_dir):
    """Snapshots by their names, each user's newest first; other files don't count, and a name that is no time is shown as it is."""
    name = F.when(F.col("value") >= 70, F.date_format("ts", "yyyyMMdd_HHmmss")).otherwise("20241399_000000")
    files = table(spark, sf_dir, "events").select("user_id", "event_id", F.concat(name, F.when(F.col("value") >= 60, ".json").otherwise(".tmp")).alias("filename"))
    rows = files.where(F.col("filename").rlike(dates.SNAPSHOT_NAME)).withColumn("shown", dates.snapshot_time(F.col("filename")))
    newest = Window.partitionBy("user_id").orderBy(F.desc("filename"), F.desc("event_id"))
    return rows.withColumn("place", F.row_number().over(newest))


@query("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value < 50 DESC, event_id DESC) AS INTEGER) AS place FROM events")
def snk06_index(spark, sf_dir):
    """An index grows at the front: writes are appended with their number, and a reader puts the last one first."""
    path, own = _path(spark, "index"), table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    for number, side in enumerate((F.coalesce(F.col("value") >= 50, F.lit(True)), F.col("value") < 50)):
        own.where(side).select("user_id", "event_id", F.lit(number).alias("write")).write.mode("append").parquet(path)
    newest = Window.partitionBy("user_id").orderBy(F.desc("write"), F.desc("event_id"))
    return spark.read.schema("user_id long, event_id long, write int").parquet(path).select("user_id", "event_id", F.row_number().over(newest).alias("place"))


@query("""SELECT l_orderkey, l_linenumber, dayofweek(CAST(o_orderdate AS DATE)) = 1 AS on_monday,
        date_trunc('month', CAST(o_orderdate AS DATE)) = date_trunc('month', CAST(l_shipdate AS DATE)) AS one_month,
        CAST(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) + 1 AS INTEGER) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def dat07_period_facts(spark, sf_dir):
    """Of the period from an order to its shipping: whether it starts on a Monday, whether it is of one month, and its days, both ends included."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("start"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("end")).join(orders, "l_orderkey")
    start, end = F.col("start"), F.col("end")
    same = F.trunc(start, "MM") == F.trunc(end, "MM")
    return rows.select("l_orderkey", "l_linenumber", (F.weekday(start) == 0).alias("on_monday"), same.alias("one_month"), (F.datediff(end, start) + 1).alias("days"))


@query("""SELECT event_id, CASE WHEN value < 60 AND value >= 30 THEN event_type WHEN value >= 80 THEN event_type || '|' || user_id ELSE '' END AS items,
        CASE WHEN value >= 80 THEN 2 WHEN value >= 30 AND value < 60 THEN 1 ELSE 0 END AS n FROM events""")
def arr02_as_list(spark, sf_dir):
    """A value of a document as a list: a list as it is, nothing and an empty text as an empty one, any other as its only item."""
    v, both = F.col("value"), F.to_json(F.array("event_type", F.col("user_id").cast("string")))
    doc = F.when(v >= 80, both).when(v >= 60, '""').when(v >= 30, F.concat(F.lit('"'), "event_type", F.lit('"'))).otherwise("null")
    rows = table(spark, sf_dir, "events").select("event_id", ls.as_list(F.parse_json(doc)).alias("own"))
    texts = F.transform("own", lambda x: F.variant_get(x, "$", "string"))
    return rows.select("event_id", F.array_join(texts, "|").alias("items"), F.size("own").alias("n"))
