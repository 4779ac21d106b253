"""Projections, filters, lists and formats of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..functions import text as tx
from ..operators import listings as ls
from ..operators import lines, tables
from ..operators import revisions as rv
from ..registry import query, table
from ..sources import documents as docs
from .tables import _documents
from .text import LINES_SQL, document_lines


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS weight, l_extendedprice AS this_month, l_extendedprice AS this_week, l_extendedprice AS this_period FROM lineitem")
def prj04_renamed(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("weight"), F.col("l_extendedprice").alias("this_period"))
    return rows.withColumns({name: F.col("this_period") for name in ("this_month", "this_week")})


@query("SELECT CAST(event_id AS VARCHAR) AS report_id, 'u' || user_id AS username, CAST(ts AS DATE) AS date, CAST(floor(value) AS INTEGER) AS revision, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS generated_at FROM events WHERE event_id % 97 <> 0")
def prj05_provenance(spark, sf_dir):
    own = docs.reports(docs.json_lines(spark, _documents(spark, sf_dir)))
    return own.select("report_id", "username", "date", "revision", F.date_format("generated_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("generated_at"))


@query("SELECT CAST(event_id AS VARCHAR) AS report_id, 'direct' AS category, 'P ' || (event_id % 7) AS name, 'Fitter' AS role, '07:00 - 17:00' AS hours_raw FROM events WHERE event_id % 97 <> 0")
def prj07_crew(spark, sf_dir):
    return docs.assignments(docs.typed(docs.reports(docs.json_lines(spark, _documents(spark, sf_dir))))).select("report_id", "category", "name", "role", "hours_raw")


@query("SELECT CAST(event_id AS VARCHAR) AS report_id, CAST(0 AS INTEGER) AS area_pos, event_type AS area_id, CAST(p AS INTEGER) AS pos, CASE p WHEN 0 THEN 'Test' ELSE 'test' END AS activity FROM events, (VALUES (0), (1)) v(p) WHERE event_id % 97 <> 0")
def arr01_nested_activities(spark, sf_dir):
    own = docs.reports(docs.json_lines(spark, _documents(spark, sf_dir)))
    return docs.activities(docs.areas(docs.typed(own))).select("report_id", "area_pos", "area_id", "pos", "activity")


@query("""SELECT user_id, event_id, coalesce(nullif(CASE WHEN event_type LIKE '%c%' THEN event_type ELSE '' END, ''), 'Issued') AS description FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 3""")
def prj09_revision_rows(spark, sf_dir):
    last = rv.newest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 3)
    named = tx.first_present(F.when(F.contains("event_type", F.lit("c")), F.col("event_type")).otherwise(""), F.lit("Issued"))
    return last.select("user_id", "event_id", named.alias("description"))


@query("""WITH d AS (SELECT o_orderkey, n AS number, 'Appendix ' || n AS title FROM orders, (VALUES (1), (2), (3)) v(n)), s AS (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS title FROM lineitem GROUP BY ALL)
    SELECT coalesce(o_orderkey, l_orderkey) AS o_orderkey, CAST(coalesce(number, l_linenumber) AS INTEGER) AS number, coalesce(s.title, d.title) AS title FROM d FULL JOIN s ON o_orderkey = l_orderkey AND number = l_linenumber""")
def prj11_appendices(spark, sf_dir):
    number = F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("number")
    defaults = table(spark, sf_dir, "orders").select("o_orderkey", number).withColumn("title", F.concat(F.lit("Appendix "), F.col("number").cast("string")))
    stored = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("number")).agg(F.max("l_returnflag").alias("title"))
    return tables.overlay(defaults, stored, ["o_orderkey", "number"])


@query("SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, md5(x) AS digest FROM (SELECT conv_id, turn, unnest(string_split(role || chr(10) || text, chr(10))) AS x, generate_subscripts(string_split(role || chr(10) || text, chr(10)), 1) - 1 AS pos FROM conversations) WHERE trim(x) <> ''")
def prj18_content_rows(spark, sf_dir):
    every = F.concat(F.array("role"), F.split("text", "\n"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(every).alias("pos", "x"))
    return rows.where(F.trim("x") != "").select("conv_id", "turn", "pos", F.md5(F.col("x").cast("binary")).alias("digest"))


@query("SELECT event_id, '{\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS stored FROM events")
def prj20_accepted_keys(spark, sf_dir):
    sent = F.concat(F.lit('{"other": [1, 2], '), F.substring("props", F.lit(2), F.length("props")))
    return table(spark, sf_dir, "events").select("event_id", F.to_json(F.from_json(sent, "k int")).alias("stored"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal >= 0 AND c_mktsegment NOT IN ('FURNITURE', 'MACHINERY')")
def flt15_roster(spark, sf_dir):
    own = table(spark, sf_dir, "customer").where((F.col("c_acctbal") >= 0) & ~F.col("c_mktsegment").isin("FURNITURE", "MACHINERY"))
    return own.select("c_custkey", "c_mktsegment")


@query("SELECT page_id, strlen(html) <= 31457280 AND length(html) <= 500000 AS accepted FROM pages")
def flt17_import_limits(spark, sf_dir):
    within = (F.octet_length("html") <= 30 << 20) & (F.length("html") <= 500_000)
    return table(spark, sf_dir, "pages").select("page_id", within.alias("accepted"))


@query(LINES_SQL + "SELECT doc_id, line_no FROM l WHERE trim(text) <> ''")
def flt20_filled_lines(spark, sf_dir):
    return document_lines(spark, sf_dir).where(F.trim("text") != "").select("doc_id", "line_no")


@query("SELECT page_id, regexp_matches(p, '^[A-Za-z0-9][A-Za-z0-9._-]*$') AND NOT contains(p, '..') AS safe FROM (SELECT page_id, regexp_replace(url, '^.*/', '') AS p FROM pages)")
def flt21_safe_component(spark, sf_dir):
    part = tx.base_name(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", (part.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$") & ~F.contains(part, F.lit(".."))).alias("safe"))


@query("SELECT CAST(ts AS DATE) AS date, count(*) AS reports, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def agg01_by_date(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias("reports"), F.count_distinct("user_id").alias("users"))


@query("SELECT l_orderkey, arg_min(l_returnflag, (l_linenumber, l_partkey, l_suppkey, l_returnflag)) FILTER (l_returnflag <> 'N') AS role FROM lineitem GROUP BY l_orderkey")
def agg06_first_role(spark, sf_dir):
    filled = F.when(F.col("l_returnflag") != "N", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(filled)["l_returnflag"].alias("role"))


@query("SELECT CAST(o_orderdate AS DATE) AS date, round(sum(CAST(l_quantity * 100 AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT)) / 10000.0, 4) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def agg17_daily_overall(spark, sf_dir):
    term = (F.col("l_quantity") * 100).cast("long") * F.round(F.col("l_discount") * 100).cast("long")
    per_order = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(term).alias("n"))
    days = per_order.join(table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date")), "o_orderkey")
    return days.groupBy("date").agg(F.round(F.sum("n") / 10_000.0, 4).alias("total"))


@query("SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, CAST(sum(CASE WHEN length(text) > 200 THEN 1 ELSE 0 END) AS BIGINT) AS long FROM conversations GROUP BY role")
def agg30_counters(spark, sf_dir):
    long = F.count_if(F.length("text") > 200)
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("conversations"), long.alias("long"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'F,late' WHEN o_orderpriority = '1-URGENT' THEN o_orderstatus || ',late' ELSE o_orderstatus END AS warnings FROM orders")
def ded07_warnings_once(spark, sf_dir):
    late = F.when((F.col("o_orderstatus") == "F") | (F.col("o_orderpriority") == "1-URGENT"), F.array(F.lit("late"), F.lit("late"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.array_union(F.array("o_orderstatus"), late), ",").alias("warnings"))


@query("SELECT o_custkey, string_agg(DISTINCT strftime(o_orderdate, '%Y-%m-%d'), ',' ORDER BY strftime(o_orderdate, '%Y-%m-%d')) AS expected FROM orders GROUP BY o_custkey")
def ded09_expected_dates(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    return ls.listed(rows, ["o_custkey"], "d").select("o_custkey", F.array_join("d", ",").alias("expected"))


@query("SELECT user_id, CAST(ts AS DATE) AS date, event_id, CAST(row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY value DESC, ts DESC, event_id DESC) AS INTEGER) AS rank FROM events")
def win01_candidates(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("user_id", "date").orderBy(F.desc("value"), F.desc("ts"), F.desc("event_id"))
    rows = table(spark, sf_dir, "events").withColumn("date", F.to_date("ts"))
    return rows.select("user_id", "date", "event_id", F.row_number().over(order).alias("rank"))


@query("SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_event_type, arg_max(event_type, (ts, event_id)) AS last_event_type, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY user_id")
def win02_first_last(spark, sf_dir):
    from ..operators import progress

    return progress.first_and_last(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type", "value"])


@query("SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) AS date FROM orders ORDER BY date, o_custkey, o_orderstatus, o_orderpriority, o_totalprice, o_orderkey")
def top01_record_order(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("date", F.to_date("o_orderdate"))
    return rows.orderBy("date", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderkey").select("o_orderkey", "o_custkey", "o_orderstatus", "date")


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS n FROM lineitem) WHERE n <= 100")
def top10_first_100(spark, sf_dir):
    order = [F.asc(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")]
    return rv.newest(table(spark, sf_dir, "lineitem"), ["l_suppkey"], order, 100).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT 'customer' AS kind, c_custkey AS key, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_nationkey FROM supplier")
def set02_all_owners(spark, sf_dir):
    one = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"))
    return one.unionByName(table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation")))


@query("SELECT conv_id, turn, length(trim(regexp_replace(role || '  ' || text, '\\s+', ' ', 'g'))) AS n, md5(trim(regexp_replace(role || '  ' || text, '\\s+', ' ', 'g'))) AS digest FROM conversations")
def str02_clean_text(spark, sf_dir):
    text = tx.clean_text(F.concat_ws(" \n", "role", "text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(text).cast("long").alias("n"), F.md5(text.cast("binary")).alias("digest"))


@query("SELECT event_id, event_type || '|' || user_id || CASE WHEN value > 50 THEN '|in \"quotes\"' ELSE '' END AS flat FROM events")
def str12_nested_texts(spark, sf_dir):
    """Lists of depth 0 to 12 around a text, between others; numbers and objects hold no text."""
    depth = (F.col("event_id") % 13).cast("int")
    deep = F.concat(F.repeat(F.lit("["), depth), F.to_json(F.array(F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit("\n")))), F.repeat(F.lit("]"), depth))
    last = F.when(F.col("value") > 50, r'["in  \"quotes\"", {"text": "{no", "list": ["no"]}]').otherwise('{"text": "no"}')
    value = F.try_parse_json(F.concat(F.lit('["'), "event_type", F.lit('", 7, null, " ", '), deep, F.lit(", "), last, F.lit("]")))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(docs.texts(value), "|").alias("flat"))


@query(LINES_SQL + "SELECT doc_id, line_no, coalesce(last_value(CASE WHEN regexp_matches(text, '^[A-Z]') THEN 'today' WHEN regexp_matches(text, '^[a-z]') THEN 'tomorrow' END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no), 'none') AS mode FROM l")
def str18_column_mode(spark, sf_dir):
    marker = F.when(F.col("text").rlike("^[A-Z]"), "today").when(F.col("text").rlike("^[a-z]"), "tomorrow")
    return lines.section_fill(document_lines(spark, sf_dir), marker).select("doc_id", "line_no", F.coalesce("section", F.lit("none")).alias("mode"))


@query("SELECT o_orderkey, 'Order ' || o_orderkey || chr(10) || strftime(o_orderdate, '%d.%m.%Y') || chr(10) || '- ' || o_orderpriority AS shared FROM orders")
def str21_shared_text(spark, sf_dir):
    parts = F.array(F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), F.date_format("o_orderdate", "dd.MM.yyyy"), F.concat(F.lit("- "), "o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(parts, "\n").alias("shared"))


@query("SELECT event_id, greatest(0, CAST(floor(value) AS INTEGER) - 30) AS whole, greatest(0.0, value - 30) AS part FROM events")
def num08_clamped(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.greatest(F.lit(0), F.floor("value").cast("int") - 30).alias("whole"), F.greatest(F.lit(0.0), F.col("value") - 30).alias("part"))


@query("SELECT user_id, arg_max(event_id, (CASE WHEN event_type = 'error' THEN -1 ELSE epoch(date_trunc('second', ts)) END, event_id)) AS last_id FROM events GROUP BY user_id")
def dat03_timestamp_order(spark, sf_dir):
    stamp = dates.utc_timestamp(F.when(F.col("event_type") == "error", "never").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    return rv.latest(table(spark, sf_dir, "events").select("user_id", "event_id", stamp.alias("at")), ["user_id"], ["at", "event_id"]).select("user_id", F.col("event_id").alias("last_id"))


@query("SELECT o_orderkey, day(o_orderdate) || ' ' || (['Januari', 'Februari', 'Maret', 'April', 'Mei', 'Juni', 'Juli', 'Agustus', 'September', 'Oktober', 'November', 'Desember'])[month(o_orderdate)] || ' ' || year(o_orderdate) AS shown FROM orders")
def dat09_long_date(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.long_date(F.col("o_orderdate")).alias("shown"))


@query("SELECT vec_id, len(list_filter(embedding, lambda x: x > 0)) AS positive, round(CAST(list_sum(list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE))) AS DOUBLE), 6) AS head FROM embeddings")
def arr03_list_operations(spark, sf_dir):
    head = F.aggregate(F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("positive"), F.round(head, 6).alias("head"))


@query("SELECT user_id, event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'")
def src10_one_date(spark, sf_dir):
    day = (F.col("ts") >= "2024-01-10") & (F.col("ts") < "2024-01-11")
    return table(spark, sf_dir, "events").where(day).select("user_id", "event_id", "event_type")
