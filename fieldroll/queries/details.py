"""Sources, submissions, logs and rows under other names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import enums, numbers
from ..functions import text as tx
from ..operators import manpower
from ..registry import query, table
from ..sources import documents as docs
from ..sources import sinks
from ..sources.keyed import KeyedTable
from ..streaming import retention
from ..streaming import revisions as streams
from .stores import _path, _stream
from .text import LINES_SQL, document_lines


@query("SELECT event_type AS owner, count(*) AS documents, count(*) FILTER (event_id % 5 = 0) AS unreadable FROM events GROUP BY event_type")
def src04_unreadable(spark, sf_dir):
    """What a scan leaves out: documents cut off in their last character aren't JSON."""
    text = F.when(F.col("event_id") % 5 == 0, F.substring(F.col("props"), F.lit(1), F.length("props") - 1)).otherwise(F.col("props"))
    own = table(spark, sf_dir, "events").select(F.col("event_type").alias("owner"), F.try_parse_json(text).alias("doc"))
    return own.groupBy("owner").agg(F.count("*").alias("documents"), F.count_if(F.col("doc").isNull()).alias("unreadable"))


@query("""SELECT page_id, CAST(strlen(c) AS BIGINT) AS size_bytes, starts_with(c, '%PDF-') AS is_pdf, strlen(c) <= 31457280 AND starts_with(c, '%PDF-') AS accepted
    FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '%PDF-' || html ELSE html END AS c FROM pages)""")
def src06_sources(spark, sf_dir):
    content = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("%PDF-"), "html")).otherwise(F.col("html")).cast("binary")
    own = table(spark, sf_dir, "pages").select("page_id", F.octet_length(content).cast("long").alias("size_bytes"), sinks.is_pdf(content).alias("is_pdf"))
    return own.withColumn("accepted", (F.col("size_bytes") <= 30 << 20) & F.col("is_pdf"))


@query("SELECT sha256(text) AS sha256, CAST(strlen(any_value(text)) AS BIGINT) AS size_bytes, count(DISTINCT source) AS owners, sha256(any_value(text)) AS read_again FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)")
def snk04_assets(spark, sf_dir):
    """A store that holds each content once, under its digest, with an index of who has it; contents come in two writes that share some."""
    files = table(spark, sf_dir, "documents").where("text is not null").select(F.col("text").cast("binary").alias("content"), "source", "lang")
    store = sinks.AssetStore(spark, _path(spark, "assets"))
    for side in (F.col("lang") == "en", F.lit(True)):
        store.add(files.where(side), "source")
    owners = store.index().groupBy("sha256").agg(F.count_distinct("owner").alias("owners"))
    return store.contents().join(owners, "sha256").select("sha256", "size_bytes", "owners", F.sha2("content", 256).alias("read_again"))


@query("""SELECT user_id, CAST(ts AS DATE) AS date, event_type AS area_id, max(event_id) AS submission FROM events GROUP BY ALL""")
def stm02_submissions(spark, sf_dir):
    """A later submission of the same user, day and area takes the place of an earlier one; the earlier may come in a later batch."""
    own = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("date"), F.col("event_type").alias("area_id"), F.col("event_id").alias("submission"), "value")
    store = KeyedTable(spark, _path(spark, "submissions"), "user_id long, date date, area_id string, submission long", ["user_id", "date", "area_id"])
    parts = [own.where(side).drop("value") for side in (F.col("value") >= 50, F.col("value") < 50)]
    streams.upsert_stream(_stream(spark, sf_dir, *parts), store, ["submission"], _path(spark, "offsets")).awaitTermination()
    return store.read()


@query("SELECT user_id, event_id, action FROM (SELECT user_id, event_id, event_type AS action, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 1000")
def stm03_log(spark, sf_dir):
    """A stream of entries, of which a table keeps the newest 1,000 of each user; run twice, so that it starts again in its midst."""
    own = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").alias("action"), "value")
    store = KeyedTable(spark, _path(spark, "log"), "user_id long, version long, entries array<struct<at:timestamp,id:long,row:struct<action:string>>>", ["user_id"])
    source, offsets = _path(spark, "entries"), _path(spark, "offsets")
    for side in (F.col("value") >= 50, F.col("value") < 50):
        own.where(side).drop("value").write.mode("append").parquet(source)
        stream = spark.readStream.schema(own.drop("value").schema).parquet(source)
        retention.keep_newest(retention.newest(stream, ["user_id"], "ts", "event_id", ["action"], 1000, late="400 days"), store, offsets).awaitTermination()
    return store.read().select("user_id", F.explode("entries").alias("e")).select("user_id", F.col("e.id").alias("event_id"), "e.row.action")


def _orders(spark, sf_dir, record):
    """o_orderkey, o_orderdate and doc: an order as a JSON record."""
    own = table(spark, sf_dir, "orders")
    return own.select("o_orderkey", "o_orderdate", F.parse_json(F.to_json(record)).alias("doc"))


@query("""SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS number, CASE o_orderkey % 4 WHEN 3 THEN '-' ELSE o_orderpriority END AS description, o_orderstatus AS status FROM orders""")
def prj08_purchase_rows(spark, sf_dir):
    """Rows of a table whose records name the same field differently, one of them left blank."""
    k, number = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    record = F.struct(
        F.when(k == 0, number).otherwise("").alias("po_no"), F.when(k == 1, number).alias("po_number"), F.when(k > 1, number).alias("number"),
        F.when(k.isin(0, 2), F.col("o_orderpriority")).alias("description"), F.when(k == 1, F.col("o_orderpriority")).alias("item"), F.col("o_orderstatus").alias("state"),
    )
    names = {"number": ("po_no", "po_number", "number"), "description": ("description", "item"), "status": ("status", "state")}
    return _orders(spark, sf_dir, record).select("o_orderkey", *(docs.aliased(F.col("doc"), *own, default="-").alias(name) for name, own in names.items()))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderdate AS DATE) END AS date FROM orders")
def prj15_record_date(spark, sf_dir):
    k, day, other = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("1999-01-01")
    record = F.struct(
        F.when(k == 0, day).alias("report_date"), F.when(k == 0, other).when(k == 1, day).alias("date"),
        F.struct(F.when(k < 2, other).when(k == 2, day).otherwise("soon").alias("date")).alias("payload"),
    )
    return _orders(spark, sf_dir, record).select("o_orderkey", docs.aliased(F.col("doc"), "report_date", "date", "payload.date").try_cast("date").alias("date"))


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN 0.8 WHEN '3-MEDIUM' THEN 1.0 WHEN '5-LOW' THEN 0.0 ELSE 0.7 END AS confidence FROM orders""")
def cnf01_field_confidence(spark, sf_dir):
    """By how a field was found, which an order's priority stands for; 5-LOW: it wasn't."""
    found_by = F.create_map(*(F.lit(x) for pair in {"1-URGENT": "label", "2-HIGH": "unique", "3-MEDIUM": "master", "4-NOT SPECIFIED": "similar"}.items() for x in pair))
    return table(spark, sf_dir, "orders").select("o_orderkey", enums.field_confidence(F.try_element_at(found_by, "o_orderpriority")).cast("double").alias("confidence"))


@query("SELECT p_partkey, p_name || chr(10) || chr(10) || p_type || ' fi 1' || chr(10) || p_brand AS text FROM part")
def str05_page_text(spark, sf_dir):
    """Ligatures and wide digits, no-break spaces, line ends of both kinds, byte order and control marks, trailing space."""
    text = F.concat(F.lit("﻿"), "p_name", F.lit(" \t\r\n \r\x07"), "p_type", F.lit(" ﬁ １  \n\x00"), "p_brand", F.lit("  "))
    return table(spark, sf_dir, "part").select("p_partkey", tx.page_text(text).alias("text"))


@query(LINES_SQL + "SELECT doc_id, line_no, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest FROM l")
def str04_compact_lines(spark, sf_dir):
    return document_lines(spark, sf_dir).select("doc_id", "line_no", F.md5(tx.clean_text(F.col("text")).cast("binary")).alias("digest"))


@query("""WITH p AS (SELECT l_orderkey, l_suppkey, max(CASE WHEN l_partkey % 4 > 0 THEN l_linenumber END) AS hours FROM lineitem GROUP BY ALL)
    SELECT l_orderkey, count(*) AS people, count(*) FILTER (hours IS NULL) AS unparsed FROM p GROUP BY l_orderkey""")
def agg08_unparsed_hours(spark, sf_dir):
    """People of whom no entry has hours that can be read."""
    raw = F.when(F.col("l_partkey") % 4 == 0, "all day").otherwise(F.format_string("07:00 - %02d:00", F.col("l_linenumber").cast("int") + 7))
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.lit("direct").alias("category"), F.col("l_suppkey").cast("string").alias("person_key"), F.col("l_linenumber").alias("row_pos"), F.lit("").alias("role"), numbers.parse_hours(raw).alias("hours"),
    )
    people = manpower.people(rows, ["l_orderkey"])
    return people.groupBy("l_orderkey").agg(F.count("*").alias("people"), F.count_if(F.col("hours").isNull()).alias("unparsed"))
