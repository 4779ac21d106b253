"""Keyed tables, projections and sets; JSON documents end to end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import listings as ls
from ..operators import tables as tb
from ..operators.revisions import first_per_key
from ..plans.period_report import compile_period
from ..registry import query, table
from ..sources import documents as docs


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def join09_left_count(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select("c_custkey")
    return tb.counted(own, table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", "orders")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def join10_semi(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey", "left_semi")


UPSERT_SQL = """WITH a AS (SELECT user_id, event_type, max(event_id) AS event_id FROM events WHERE value < 60 GROUP BY ALL), b AS (SELECT user_id, event_type, max(event_id) AS event_id FROM events WHERE NOT value < 60 GROUP BY ALL)"""


def _halves(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return [events.where(side).groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id")) for side in (F.col("value") < 60, F.col("value") >= 60)]


@query(UPSERT_SQL + "SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, coalesce(b.event_id, a.event_id) AS event_id FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type")
def join11_upsert(spark, sf_dir):
    return tb.upsert(*_halves(spark, sf_dir), ["user_id", "event_type"])


@query("""WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS balance FROM customer WHERE c_custkey % 5 <> 0)
    SELECT c.c_custkey, coalesce(segment, 'NONE') AS segment, coalesce(balance, 0.0) AS balance FROM customer c LEFT JOIN s ON c.c_custkey = s.c_custkey""")
def join12_overlay(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    defaults = c.select("c_custkey", F.lit("NONE").alias("segment"), F.lit(0.0).alias("balance"))
    stored = c.where(k % 5 != 0).select("c_custkey", F.when(k % 2 == 0, F.col("c_mktsegment")).alias("segment"), F.when(k % 3 == 0, F.col("c_acctbal")).alias("balance"))
    return tb.overlay(defaults, stored, ["c_custkey"])


@query("SELECT o_orderkey, c_mktsegment AS title, o_orderkey % 3 = 1 AS mismatch FROM (SELECT o_orderkey, o_custkey FROM orders) JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 <> 1 UNION ALL SELECT o_orderkey, 'Other', true FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 = 1")
def join14_fill(spark, sf_dir):
    master = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("title"))
    known = master.select("o_custkey", F.col("title").alias("same"))
    k = F.col("o_orderkey") % 3
    rows = table(spark, sf_dir, "orders").join(known, "o_custkey").withColumn("title", F.when(k == 0, "  ").when(k == 1, "Other").otherwise(F.col("same")))
    return tb.fill(rows, master, "o_custkey", "title").select("o_orderkey", "title", "mismatch")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def snk07_delete(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return tb.without(table(spark, sf_dir, "orders"), lines, ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT CAST(o_orderdate AS DATE) AS date FROM orders EXCEPT SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_returnflag = 'A'")
def set03_difference(spark, sf_dir):
    shipped = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.to_date("l_shipdate").alias("date"))
    return table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).subtract(shipped)


@query("SELECT kind, count(*) AS n FROM (SELECT 'direct' AS kind FROM lineitem WHERE l_linestatus = 'O' UNION ALL SELECT 'indirect' FROM lineitem WHERE l_linestatus = 'F') GROUP BY kind")
def set01_union_all(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    parts = [lines.where(F.col("l_linestatus") == s).select(F.lit(k).alias("kind")) for s, k in (("O", "direct"), ("F", "indirect"))]
    return parts[0].unionByName(parts[1]).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, coalesce(nullif(CASE WHEN p_size > 25 THEN p_brand ELSE '' END, ''), nullif(CASE WHEN p_size > 10 THEN p_type END, ''), 'none') AS label FROM part")
def prj01_first_present(spark, sf_dir):
    size = F.col("p_size")
    label = tx.first_present(F.when(size > 25, F.col("p_brand")).otherwise(""), F.when(size > 10, F.col("p_type")), F.lit("none"))
    return table(spark, sf_dir, "part").select("p_partkey", label.alias("label"))


@query("SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS ordinal FROM part")
def prj12_ordinal(spark, sf_dir):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_name", "p_partkey"))
    return table(spark, sf_dir, "part").select("p_brand", "p_partkey", place.cast("long").alias("ordinal"))


@query("""SELECT user_id, metric, value FROM (SELECT user_id, count(*) AS events, count(DISTINCT event_type) AS kinds, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY user_id) UNPIVOT (value FOR metric IN (events, kinds, days))""")
def prj16_unpivot(spark, sf_dir):
    own = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("events"), F.count_distinct("event_type").alias("kinds"), F.count_distinct(F.to_date("ts")).alias("days"))
    return own.unpivot(["user_id"], ["events", "kinds", "days"], "metric", "value")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Closed' ELSE CAST(o_orderdate AS DATE) || ' to ' || (CAST(o_orderdate AS DATE) + 6) END AS period FROM orders")
def prj19_period_label(spark, sf_dir):
    day = F.to_date("o_orderdate")
    label = F.coalesce(F.when(F.col("o_orderstatus") == "F", "Closed"), F.concat_ws(" to ", day, F.date_add(day, 6)))
    return table(spark, sf_dir, "orders").select("o_orderkey", label.alias("period"))


@query("""WITH k AS (SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 'r' || user_id WHEN event_id % 3 = 1 THEN 's' || (user_id % 10) ELSE CAST(ts AS DATE) || ':' || event_type END AS identity FROM events)
    SELECT identity, min(event_id) AS event_id FROM k GROUP BY identity""")
def ded05_manifest(spark, sf_dir):
    k = F.col("event_id") % 3
    report, sha = F.when(k == 0, F.concat(F.lit("r"), "user_id")), F.when(k == 1, F.concat(F.lit("s"), F.col("user_id") % 10))
    identity = F.coalesce(report, sha, F.concat_ws(":", F.to_date("ts"), "event_type"))
    own = table(spark, sf_dir, "events").select("event_id", identity.alias("identity"))
    return first_per_key(own, [F.col("identity")], ["event_id"]).select("identity", "event_id")


@query("""WITH g AS (SELECT o_orderkey, list_filter([CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '5-LOW' THEN 'later' END, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' END], lambda x: x IS NOT NULL) AS given FROM orders)
    SELECT o_orderkey, array_to_string(list_concat(given, list_filter(['open', 'done', 'urgent', 'later'], lambda x: NOT list_contains(given, x))), ',') AS sections FROM g""")
def ded08_section_order(spark, sf_dir):
    """An order's own sections first, by alias, repeats and unknown ones left out, then the others."""
    given = F.array("o_orderpriority", F.concat(F.lit(" "), "o_orderstatus"), "o_orderstatus")
    order = ls.section_order(given, {"1-urgent": "urgent", "5-low": "later", "f": "done", "o": "open"}, ("open", "done", "urgent", "later"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(order, ",").alias("sections"))


@query("SELECT event_id FROM events WHERE contains(lower(event_type || ' ' || user_id), 'c')")
def flt14_search(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.contains(F.lower(F.concat_ws(" ", "event_type", "user_id")), F.lit("c"))).select("event_id")


@query("SELECT p_partkey FROM part WHERE p_size > 40 OR length(trim(p_brand)) > 8")
def flt10_any_filled(spark, sf_dir):
    fields = [F.when(F.col("p_size") > 40, F.col("p_brand")).otherwise(" "), F.when(F.length(F.trim("p_brand")) > 8, F.col("p_name"))]
    return table(spark, sf_dir, "part").where(tb.any_filled(*fields)).select("p_partkey")


@query("SELECT doc_id FROM documents WHERE regexp_matches(source, '^[A-Za-z0-9_-]{1,64}$') AND strlen(text) <= 500000")
def flt13_safe_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("source").rlike(r"^[A-Za-z0-9_-]{1,64}$") & (F.octet_length("text") <= 500_000)).select("doc_id")


def _documents(spark, sf_dir) -> str:
    """Events written as JSON report documents, one a line: a broken one for every 97th; the folder."""
    from ..sources.scratch import folder

    e = table(spark, sf_dir, "events")
    person = F.struct(F.concat(F.lit("P "), F.col("event_id") % 7).alias("name"), F.lit("Fitter").alias("role"), F.lit("07:00 - 17:00").alias("hours"))
    area = F.struct(F.col("event_type").alias("id"), F.array(F.lit("Test"), F.lit(" test ")).alias("activities_today"), F.array(F.lit("Next")).alias("activities_tomorrow"), F.lit("None").alias("constraints"), F.array(person).alias("manpower"))
    text = lambda c: c.cast("string")
    n = F.col("event_id")
    item = F.struct(
        F.concat(F.lit(" WBS  "), "event_type").alias("item_id"), F.col("event_type").alias("description"), F.concat(text(10 + n % 4), F.lit(",5 %")).alias("weight_factor"), text(n % 10).alias("cumulative_previous_plan"),
        F.when(n % 3 > 0, text(n % 9)).alias("cumulative_previous_actual"), F.lit(5).alias("this_period_actual"), text(n % 50).alias("cumulative_to_date_plan"), F.concat(text(n % 40), F.lit("%")).alias("cumulative_to_date_actual"),
    )
    record = F.struct(
        F.lit("daily_report").alias("record_type"), F.concat(F.lit("u"), "user_id").alias("username"), F.col("event_id").cast("string").alias("report_id"), F.to_date("ts").cast("string").alias("date"),
        F.concat(F.lit("P-"), F.col("user_id") % 3).alias("project_no"), F.lit("").alias("project_title"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("generated_at"), F.floor("value").cast("int").alias("revision"),
        F.struct(F.array(area).alias("areas"), F.lit("Inner title").alias("project_title"), F.array(item).alias("overall_progress"), F.when(n % 11 == 0, "No").alias("show_overall_progress")).alias("payload"),
    )
    text = F.when(F.col("event_id") % 97 == 0, "{broken").otherwise(F.to_json(record))
    path = f"{folder(spark)}/reports-{uuid.uuid4().hex}"
    e.select(text.alias("value")).write.text(path)
    return path


SELECTED_SQL = """WITH r AS (SELECT event_id, user_id, CAST(ts AS DATE) AS date, 'p-' || (user_id % 3) AS project_key, floor(value) AS revision, date_trunc('second', ts) AS made FROM events WHERE event_id % 97 <> 0 AND CAST(ts AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-30'),
    s AS (SELECT project_key, date, arg_max(event_id, (revision, made, CAST(event_id AS VARCHAR))) AS event_id FROM r GROUP BY ALL)"""


@query("SELECT CAST(event_id AS VARCHAR) AS report_id, 'u' || user_id AS username, CAST(ts AS DATE) AS date, 'P-' || (user_id % 3) AS project_no, 'Inner title' AS project_title, CAST(floor(value) AS INTEGER) AS revision FROM events WHERE event_id % 97 <> 0")
def src01_json_documents(spark, sf_dir):
    own = docs.reports(docs.json_lines(spark, _documents(spark, sf_dir)))
    return own.select("report_id", "username", "date", "project_no", "project_title", "revision")


def _compiled(spark, sf_dir, **more):
    return compile_period(docs.reports(docs.json_lines(spark, _documents(spark, sf_dir))), "2024-01-01", "2024-01-30", **more)


@query(SELECTED_SQL + "SELECT project_key, date, CAST(event_id AS VARCHAR) AS report_id FROM s")
def p1_selected_reports(spark, sf_dir):
    return _compiled(spark, sf_dir)["selected"].select("project_key", "date", "report_id")


@query(SELECTED_SQL + "SELECT project_key, date, count(*) AS direct_headcount, CAST(count(*) * 10 AS DOUBLE) AS direct_man_hours FROM s GROUP BY ALL")
def p1_manpower_daily(spark, sf_dir):
    """Each report has one person: days of three projects aren't added up."""
    return _compiled(spark, sf_dir)["manpower_daily"].select("project_key", "date", "direct_headcount", "direct_man_hours")


@query(SELECTED_SQL + "SELECT project_key, count(*) AS total_person_days, CAST(10 * count(*) AS DOUBLE) AS total_man_hours, 1 AS peak_headcount FROM s GROUP BY ALL")
def p1_manpower_totals(spark, sf_dir):
    return _compiled(spark, sf_dir)["manpower_totals"].select("project_key", "total_person_days", "total_man_hours", "peak_headcount")


@query(SELECTED_SQL + "SELECT project_key, date, e.event_type AS area_id, 'Test' AS activity FROM s JOIN events e USING (event_id)")
def p1_activities(spark, sf_dir):
    return _compiled(spark, sf_dir)["activities"].select("project_key", "date", "area_id", "activity")


@query(SELECTED_SQL + """, l AS (SELECT project_key, max(date) AS date FROM s GROUP BY ALL) SELECT project_key, date, e.event_type AS area_id, 'Next' AS activity FROM s JOIN l USING (project_key, date) JOIN events e USING (event_id)""")
def p1_tomorrow(spark, sf_dir):
    """The plan of each project's own last day."""
    return _compiled(spark, sf_dir)["tomorrow"].select("project_key", "date", "area_id", "activity")


@query(SELECTED_SQL + """, n AS (SELECT project_key, date, count(*) AS n FROM r GROUP BY ALL), x AS (SELECT *, date - DATE '2024-01-01' < 20 AS expected FROM n)
    SELECT project_key, count(*) AS covered_days, 20 - count(*) FILTER (expected) AS missing_days, count(*) FILTER (NOT expected) AS extra_days, CAST(sum(n - 1) AS BIGINT) AS superseded_count, count(*) FILTER (n > 1) AS duplicate_days FROM x GROUP BY ALL""")
def p1_coverage(spark, sf_dir):
    """Of the first 20 days that were expected."""
    gold = _compiled(spark, sf_dir, expected_dates=[f"2024-01-{d:02}" for d in range(1, 21)])
    return gold["coverage"].select("project_key", "covered_days", "missing_days", "extra_days", "superseded_count", "duplicate_days")


PROGRESS_SQL = SELECTED_SQL + """, h AS (SELECT project_key, date, 'id:wbs ' || lower(event_type) AS key, 10.5 + event_id % 4 AS weight, event_id % 10 AS pp, CASE WHEN event_id % 3 > 0 THEN event_id % 9 END AS pa, event_id % 50 AS tp, event_id % 40 AS ta
    FROM s JOIN events USING (event_id) WHERE event_id % 11 <> 0),
    i AS (SELECT project_key, key, min(date) AS first_source_date, max(date) AS last_source_date, CAST(arg_max(weight, date) AS DOUBLE) AS weight, CAST(arg_min(pp, date) AS DOUBLE) AS previous_plan, CAST(arg_min_null(pa, date) AS DOUBLE) AS previous_actual, CAST(arg_max(tp, date) AS DOUBLE) AS to_date_plan, CAST(arg_max(ta, date) AS DOUBLE) AS to_date_actual FROM h GROUP BY ALL),
    t AS (SELECT *, to_date_plan - previous_plan AS period_plan, coalesce(to_date_actual - previous_actual, 5.0) AS period_actual FROM i)"""


@query(PROGRESS_SQL + "SELECT project_key, key, first_source_date, last_source_date, weight, previous_plan, previous_actual, period_plan, period_actual, to_date_plan, to_date_actual, to_date_actual - to_date_plan AS deviation FROM t")
def p1_progress(spark, sf_dir):
    """Items of three projects, from the reports that show progress."""
    return _compiled(spark, sf_dir)["progress"].drop("title_key", "description", "duration", "start", "finish")


@query(PROGRESS_SQL + """SELECT project_key, round(sum(weight), 6) AS weight, round(sum(weight * previous_plan / 100), 6) AS previous_plan, round(sum(weight * period_actual / 100), 6) AS period_actual, round(sum(weight * to_date_plan / 100), 6) AS to_date_plan,
    round(round(sum(weight * to_date_actual / 100), 6) - round(sum(weight * to_date_plan / 100), 6), 6) AS deviation FROM t GROUP BY project_key""")
def p1_progress_totals(spark, sf_dir):
    return _compiled(spark, sf_dir)["progress_totals"].select("project_key", "weight", "previous_plan", "period_actual", "to_date_plan", "deviation")


@query("""SELECT counter, n FROM (SELECT count(*) AS reports, 0 AS without_date, count(*) FILTER (NOT inside) AS outside, count(*) FILTER (inside AND p <> 1) AS other_projects, count(*) FILTER (inside AND p = 1) AS in_period
    FROM (SELECT user_id % 3 AS p, CAST(ts AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-30' AS inside FROM events WHERE event_id % 97 <> 0)) UNPIVOT (n FOR counter IN (reports, without_date, outside, other_projects, in_period))""")
def agg30_compile_counters(spark, sf_dir):
    """What was seen while the reports of one project were read, observed in the scan that selects them."""
    counters = _compiled(spark, sf_dir, project_no=" p-1 ").counters
    return spark.createDataFrame(sorted(counters.items()), "counter string, n long")
