"""Records and what is shown of them: contexts, provenance, names, numbers of letters, filters of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, enums, numbers
from ..functions import text as tx
from ..operators import progress, tables
from ..operators import revisions as rv
from ..registry import query, table
from ..sources.documents import without_inline


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag <> 'N' OR l_linestatus = 'F'")
def flt06_blank_rows(spark, sf_dir):
    name = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).otherwise("  ")
    role = F.when(F.col("l_linestatus") == "F", F.col("l_linestatus"))
    return table(spark, sf_dir, "lineitem").where(tables.any_filled(name, role)).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT DISTINCT o_custkey FROM orders WHERE NOT o_orderdate BETWEEN TIMESTAMP '1993-01-01' AND TIMESTAMP '1997-12-31'")
def flt08_expected_in_range(spark, sf_dir):
    out = ~F.col("o_orderdate").between(F.lit("1993-01-01").cast("timestamp"), F.lit("1997-12-31").cast("timestamp"))
    return table(spark, sf_dir, "orders").where(out).select("o_custkey").distinct()


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'")
def flt11_total_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderstatus") == "F", " Total Overall ").otherwise(F.col("o_orderstatus")).alias("label"))
    return progress.detail(rows, "label").drop("label")


@query("SELECT arg_min(p_brand, p_partkey) AS p_brand, arg_min(p_type, p_partkey) AS p_type, min(p_partkey) AS p_partkey FROM part GROUP BY lower(p_brand), lower(p_type)")
def flt12_known_projects(spark, sf_dir):
    case = lambda c: F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.col(c))).otherwise(F.col(c)).alias(c)
    return tables.known_projects(table(spark, sf_dir, "part").select(case("p_brand"), case("p_type"), "p_partkey"), "p_brand", "p_type", "p_partkey")


@query("""SELECT event_id, '{"keep":{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '},"list":["a",' || repeat('[', CAST(event_id % 12 AS INTEGER)) || '{"deep":"' || event_type || '"}' || repeat(']', CAST(event_id % 12 AS INTEGER)) || ']}' AS cleaned FROM events""")
def jsn02_without_inline(spark, sf_dir):
    """Images and signatures at depths 0 to 12, in lists and in objects."""
    depth = (F.col("event_id") % 12).cast("int")
    deep = F.concat(F.repeat(F.lit("["), depth), F.lit('{"photo_path": {"a": [1, {}]}, "deep": "'), "event_type", F.lit('", "image_data": null}, " DATA:x;base64,AA"'), F.repeat(F.lit("]"), depth))
    doc = F.concat(F.lit('{"img_data": "x", "list": ["a", "data:image/png;base64,AAAA", '), deep, F.lit('], "sig": "'), F.repeat(F.lit("A"), 128), F.lit('", "keep": '), "props", F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", without_inline(doc).alias("cleaned"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem SEMI JOIN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') o ON l_orderkey = o_orderkey")
def join03_selected(spark, sf_dir):
    chosen = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(chosen, "l_orderkey", "left_semi")


@query("SELECT c_custkey, n_name AS path FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND c_custkey % 3 <> 0")
def join08_path_of_photo(spark, sf_dir):
    paths = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("photo"), F.col("n_name").alias("path"))
    own = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")).alias("photo"))
    return own.join(paths, "photo", "left").drop("photo")


@query("""WITH i AS (SELECT o_custkey, year(o_orderdate) AS year, o_orderkey FROM orders WHERE o_orderstatus = 'F'), n AS (SELECT o_orderkey, o_custkey, year(o_orderdate) AS year FROM orders WHERE o_orderstatus <> 'F')
    SELECT n.o_orderkey, count(i.o_orderkey) AS known, max(i.o_orderkey) AS last_key FROM n LEFT JOIN i USING (o_custkey, year) GROUP BY n.o_orderkey""")
def join15_same_period(spark, sf_dir):
    """New orders against an index of the finished ones of the same customer and year: how many it holds, and the last. The index is counted before the join."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"), "o_orderstatus")
    index = orders.where("o_orderstatus = 'F'").groupBy("o_custkey", "year").agg(F.count("*").alias("known"), F.max("o_orderkey").alias("last_key"))
    found = orders.where("o_orderstatus <> 'F'").join(index, ["o_custkey", "year"], "left")
    return found.select("o_orderkey", F.coalesce("known", F.lit(0)).alias("known"), "last_key")


@query("SELECT l_orderkey, sum(l_quantity) AS weight, round(sum(l_quantity * l_discount * 100 / 100), 6) AS progress FROM lineitem GROUP BY l_orderkey")
def agg16_weight_total(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("weight"), (F.col("l_discount") * 100).alias("value"))
    return rows.groupBy("l_orderkey").agg(F.sum("weight").alias("weight"), progress.weighted("value").alias("progress"))


@query("SELECT printf('%04d/%s/%s/%d', n, 'site', ['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X', 'XI', 'XII'][month(d)], year(d)) AS letter_no FROM (SELECT max(o_custkey) + 1 AS n, max(o_orderdate) AS d FROM orders)")
def agg22_letter_number(spark, sf_dir):
    last = table(spark, sf_dir, "orders").agg((F.max("o_custkey") + 1).alias("n"), F.max("o_orderdate").alias("d"))
    return last.select(tx.letter_number(F.col("n"), F.col("d"), "site").alias("letter_no"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 20")
def top09_last_20_turns(spark, sf_dir):
    return rv.newest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], [F.desc("turn")], 20)


@query("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS place FROM events")
def top04_in_order_of_submission(spark, sf_dir):
    from ..operators.listings import renumbered

    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("at"))
    return renumbered(rows, ["user_id"], "at", F.lit(True)).select("user_id", "event_id", F.col("number").alias("place"))


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS company, coalesce(arg_max(CASE WHEN value > 50 THEN 'over' ELSE '' END, (ts, event_id)), 'none') AS level FROM events GROUP BY user_id""")
def prj13_latest_context(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("company"), F.when(F.col("value") > 50, "over").otherwise("").alias("level"))
    return tables.latest_context(rows, ["user_id"], ["ts", "event_id"], {"company": "-", "level": "none"})


@query("SELECT s_suppkey, coalesce(nullif(CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END, ''), 'Nation ' || s_nationkey) AS title, s_nationkey AS project_no FROM supplier")
def prj14_candidates(spark, sf_dir):
    title = tx.first_present(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise(""), F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", title.alias("title"), F.col("s_nationkey").alias("project_no"))


@query("""SELECT printf('Overall progress is %.2f%% against a plan of %.2f%% (variance %+.2f%%).', t, p, t - p) AS text FROM (SELECT CAST(arg_max(l_quantity, (l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS DOUBLE) AS t, arg_max(l_linenumber, (l_orderkey, l_linenumber, l_partkey, l_suppkey))::DOUBLE AS p FROM lineitem)""")
def prj17_summary(spark, sf_dir):
    plan = F.col("l_linenumber").cast("double")
    at = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("at")
    rows = table(spark, sf_dir, "lineitem").select(at, F.col("l_quantity").alias("to_date"), plan.alias("plan"), (F.col("l_quantity") - plan).alias("variance"), F.lit(True).alias("is_total"), F.lit("Total").alias("label"))
    return progress.summary(rows, "at", "label")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_name END AS first, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END AS second FROM part")
def prj21_swapped(spark, sf_dir):
    swapped = F.col("p_size") % 2 == 0
    return table(spark, sf_dir, "part").select("p_partkey", F.when(swapped, F.col("p_type")).otherwise(F.col("p_name")).alias("first"), F.when(swapped, F.col("p_name")).otherwise(F.col("p_type")).alias("second"))


@query("SELECT o_orderkey, 'Weekly Progress Report - ' || o_custkey || '-x - ' || CAST(o_orderdate AS DATE) || ' to ' || CAST(o_orderdate AS DATE) || ' (WTD) - R' || o_orderkey % 7 || '.pdf' AS name FROM orders")
def str13_report_file_names(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    name = tx.report_file_name(F.lit("weekly"), F.concat(F.col("o_custkey").cast("string"), F.lit("/*x..")), day, day, F.lit("wtd"), F.col("o_orderkey") % 7)
    return table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name"))


@query("SELECT event_id, upper(CASE WHEN event_type LIKE '%c%' THEN event_type ELSE 'warning' END) || ': ' || event_id AS warning FROM events")
def str19_warning_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", tx.labelled(F.when(F.contains("event_type", F.lit("c")), F.col("event_type")), F.col("event_id").cast("string"), "warning").alias("warning"))


@query("SELECT p_partkey, '6.' || p_size || '    ' || p_name || CASE WHEN p_size % 2 = 0 THEN '  [' || p_brand || ']' ELSE '' END AS label FROM part")
def str20_appendix_label(spark, sf_dir):
    status = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(" ")
    return table(spark, sf_dir, "part").select("p_partkey", tx.appendix_label(F.concat(F.lit("6."), F.col("p_size").cast("string")), F.col("p_name"), status).alias("label"))


@query("SELECT doc_id, md5(left(trim(text), 30000)) AS digest, length(left(trim(text), 30000)) AS n FROM documents")
def str03_review_text(spark, sf_dir):
    text = tx.review_text(F.concat(F.lit(" \0"), "text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.cast("binary")).alias("digest"), F.length(text).cast("long").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE l_quantity + l_linenumber END AS to_date, greatest(l_linenumber - 3, 0) AS clamped FROM lineitem")
def num07_to_date(spark, sf_dir):
    stated = F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))
    to_date = F.coalesce(stated, F.col("l_quantity") + F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", to_date.alias("to_date"), F.greatest(F.col("l_linenumber") - 3, F.lit(0)).alias("clamped"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) END AS date, o_orderkey % 3 = 0 AS invalid, CASE WHEN o_orderkey % 3 = 1 THEN epoch(o_orderdate) ELSE -1 END AS sort_value FROM orders")
def dat01_iso_date(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", " yyyy-MM-dd "))
    stamp = F.when(k % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("soon")
    day = dates.iso_date(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", day.alias("date"), day.isNull().alias("invalid"), F.coalesce(F.unix_timestamp(dates.utc_timestamp(stamp)), F.lit(-1)).cast("double").alias("sort_value"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_type LIKE '%c%' THEN 'final' ELSE 'wtd' END ELSE 'mtd' END AS mode, CASE WHEN event_id % 2 = 0 THEN 'weekly' ELSE 'monthly' END AS kind FROM events")
def enum01_report_mode(spark, sf_dir):
    kind = F.when(F.col("event_id") % 2 == 0, "Week_to-date").otherwise("month")
    mode = F.when(F.col("event_id") % 2 == 1, "week-to-date").when(F.contains("event_type", F.lit("c")), " FINAL").otherwise("?")
    return table(spark, sf_dir, "events").select("event_id", enums.report_mode(kind, mode).alias("mode"), enums.report_type(kind).alias("kind"))


@query("SELECT c_custkey, c_name FROM customer UNION ALL SELECT s_suppkey + 100, s_name FROM supplier WHERE s_suppkey + 100 NOT IN (SELECT c_custkey FROM customer)")
def snk11_insert_absent(spark, sf_dir):
    new = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 100).alias("c_custkey"), F.col("s_name").alias("c_name"))
    return tables.insert_absent(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), new, ["c_custkey"])


@query("SELECT p_partkey, p_size * 10.5 AS hours, CASE WHEN p_size % 2 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS guarded FROM part")
def flt19_hours_guard(spark, sf_dir):
    hours = numbers.parse_hours(F.replace((F.col("p_size") * 10.5).cast("string"), F.lit("."), F.lit(",")))
    guarded = numbers.parse_hours(F.when(F.col("p_size") % 2 == 0, "24:10-25:00").otherwise(F.col("p_size").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", hours.alias("hours"), guarded.alias("guarded"))
