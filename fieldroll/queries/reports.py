"""Revisions, coverage, calendars and periods: an event stands for a report of its user and day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, enums, numbers
from ..operators import coverage as cover
from ..operators import revisions
from ..registry import query, table

START, END = "2024-01-01", "2024-01-30"
ORDER = ["value", "ts", "event_id"]


def reports(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("report_date", F.to_date("ts"))


@query("""SELECT user_id, report_date, event_id, value FROM (
    SELECT user_id, CAST(ts AS DATE) AS report_date, event_id, value, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY value DESC, ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def agg02_latest_revision(spark, sf_dir):
    return revisions.latest(reports(spark, sf_dir), ["user_id", "report_date"], ORDER).select("user_id", "report_date", "event_id", "value")


@query("""SELECT user_id, report_date, event_id FROM (
    SELECT user_id, CAST(ts AS DATE) AS report_date, event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY value DESC, ts DESC, event_id DESC) AS n FROM events) WHERE n > 1""")
def agg03_superseded(spark, sf_dir):
    return revisions.superseded(reports(spark, sf_dir), ["user_id", "report_date"], ORDER).select("user_id", "report_date", "event_id")


@query("""SELECT event_type, user_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS report_date
    FROM (SELECT event_type, user_id, CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM events GROUP BY ALL)""")
def src13_calendar(spark, sf_dir):
    return cover.calendar(reports(spark, sf_dir), ["event_type", "user_id"], "report_date")


@query("""WITH u AS (SELECT DISTINCT user_id FROM events), s AS (SELECT user_id, CAST(d AS DATE) AS report_date FROM u, generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY) t(d))
    SELECT user_id, report_date FROM s WHERE (user_id, report_date) NOT IN (SELECT user_id, CAST(ts AS DATE) FROM events)""")
def join01_missing_dates(spark, sf_dir):
    return cover.missing_dates(reports(spark, sf_dir), START, END, ["user_id"], "report_date")


@query("""SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS order_date FROM orders WHERE NOT CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'""")
def join02_extra_dates(spark, sf_dir):
    own = table(spark, sf_dir, "orders").withColumn("order_date", F.to_date("o_orderdate"))
    return cover.extra_dates(own, "1995-01-01", "1996-12-31", ["o_custkey"], "order_date")


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-30' GROUP BY ALL)
    SELECT user_id, count(*) AS covered_days, 30 - count(*) AS missing_days, CAST(sum(n - 1) AS BIGINT) AS superseded_count, count(*) FILTER (n > 1) AS duplicate_days, max(day) AS last_report_date, count(*) < 30 AS is_partial FROM d GROUP BY user_id""")
def agg25_coverage(spark, sf_dir):
    return cover.coverage(reports(spark, sf_dir), START, END, ["user_id"], "report_date")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1995-03-31'")
def flt01_date_range(spark, sf_dir):
    own = table(spark, sf_dir, "orders").where((F.col("o_orderdate") >= "1995-01-01") & (F.col("o_orderdate") < "1995-04-01"))
    return own.select("o_orderkey", F.to_date("o_orderdate").alias("order_date"))


@query("""SELECT lang, count(*) AS n, count(*) FILTER (NOT regexp_matches(coalesce(text, ''), '^\\d{4}-\\d{2}-\\d{2}$')) AS invalid FROM documents GROUP BY lang""")
def flt03_invalid_count(spark, sf_dir):
    own = table(spark, sf_dir, "documents")
    return own.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(dates.iso_date(F.col("text")).isNull()).alias("invalid"))


@query("SELECT user_id, count(DISTINCT event_type) AS kinds, count(DISTINCT event_type) > 1 AS mixed FROM events GROUP BY user_id")
def flt04_mixed_projects(spark, sf_dir):
    kinds = F.count_distinct("event_type")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(kinds.alias("kinds"), (kinds > 1).alias("mixed"))


@query("""WITH p AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 AS INTEGER) AS b, CASE WHEN o_orderkey % 2 = 0 THEN 'weekly' ELSE 'monthly' END AS kind, CASE WHEN o_orderkey % 3 = 0 THEN 'wtd' ELSE 'final' END AS mode FROM orders)
    SELECT o_orderkey, CASE WHEN kind = 'weekly' THEN CASE WHEN isodow(a) <> 1 THEN 'start on Monday' WHEN b - a + 1 > 7 THEN 'longer than 7 days' WHEN mode <> 'wtd' AND b - a + 1 <> 7 THEN 'Monday through Sunday' END
    WHEN date_trunc('month', a) <> date_trunc('month', b) THEN 'one calendar month' END AS problem FROM p""")
def flt05_period_rules(spark, sf_dir):
    start, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    kind, mode = F.when(k % 2 == 0, "weekly").otherwise("monthly"), F.when(k % 3 == 0, "wtd").otherwise("final")
    problem = dates.period_problem(start, F.date_add(start, (k % 9).cast("int")), kind, mode)
    return table(spark, sf_dir, "orders").select("o_orderkey", problem.alias("problem"))


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT coalesce(CASE o_orderstatus WHEN 'F' THEN 'off' WHEN 'P' THEN 'TRUE' END IN ('false', '0', 'off', 'no'), false)""")
def flt07_visible(spark, sf_dir):
    flag = F.when(F.col("o_orderstatus") == "F", " OFF ").when(F.col("o_orderstatus") == "P", "TRUE")
    return table(spark, sf_dir, "orders").where(~numbers.hidden(flag)).select("o_orderkey", "o_orderstatus")


@query("SELECT o_custkey, count(*) AS n FROM orders SEMI JOIN (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events) e ON CAST(o_orderdate AS DATE) + 10227 = e.d GROUP BY o_custkey")
def flt16_exists_by_date(spark, sf_dir):
    days = reports(spark, sf_dir).select(F.col("report_date").alias("d")).distinct()
    own = table(spark, sf_dir, "orders").withColumn("d", F.date_add(F.to_date("o_orderdate"), 10227))
    return own.join(days, "d", "left_semi").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("SELECT user_id, CAST(max(CAST(floor(value) AS INTEGER)) + 1 AS INTEGER) AS next_revision FROM events GROUP BY user_id")
def agg20_next_revision(spark, sf_dir):
    return revisions.next_number(table(spark, sf_dir, "events"), ["user_id"], F.floor("value").cast("int"))


@query("SELECT user_id, event_type, string_agg(DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR), ',' ORDER BY CAST(CAST(ts AS DATE) AS VARCHAR)) AS source_dates FROM events GROUP BY user_id, event_type")
def agg24_source_dates(spark, sf_dir):
    days = F.sort_array(F.collect_set(F.to_date("ts").cast("string")))
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.array_join(days, ",").alias("source_dates"))


@query("""SELECT e.user_id, e.event_id, e.event_type FROM events e JOIN (SELECT user_id, max(CAST(ts AS DATE)) AS d FROM events GROUP BY user_id) m ON e.user_id = m.user_id AND CAST(e.ts AS DATE) = m.d""")
def top13_latest_only(spark, sf_dir):
    from ..operators.tables import latest_only

    return latest_only(reports(spark, sf_dir), ["user_id"], "report_date").select("user_id", "event_id", "event_type")


@query("""SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 19 AND ts >= TIMESTAMP '2024-01-20'""")
def top05_retention(spark, sf_dir):
    kept = revisions.newest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 19)
    return kept.where(F.col("ts") >= "2024-01-20").select("event_id", "user_id")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def top07_latest_n(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(1000).select("event_id", "user_id", "event_type")


@query("""SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS last_three FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 3 GROUP BY user_id""")
def top08_last_three(spark, sf_dir):
    own = revisions.newest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 3)
    rows = F.sort_array(F.collect_list(F.struct("ts", "event_id")))
    return own.groupBy("user_id").agg(F.array_join(F.transform(rows, lambda r: r["event_id"].cast("string")), ",").alias("last_three"))


@query("SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type, count(*) AS n, CAST(round(sum(CAST(value AS DECIMAL(18, 4))), 2) AS DOUBLE) AS total FROM events GROUP BY ALL")
def stm04_weekly(spark, sf_dir):
    own = table(spark, sf_dir, "events").groupBy(dates.week_start(F.col("ts")).alias("week"), "event_type")
    return own.agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,4)")), 2).cast("double").alias("total"))


@query("""SELECT event_id, CASE WHEN event_type LIKE '%c%' THEN 'MTD' WHEN event_type LIKE '%v%' THEN 'FINAL' ELSE 'DRAFT' END AS status FROM events""")
def enum01_status(spark, sf_dir):
    word = F.when(F.contains("event_type", F.lit("c")), " Month_to-date ").when(F.contains("event_type", F.lit("v")), "Approved").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", enums.status(word).alias("status"))


@query("""SELECT event_type, CASE WHEN contains(event_type, 'generate') THEN 'primary' WHEN contains(event_type, 'login') THEN 'success' WHEN contains(event_type, 'logout') THEN 'secondary' WHEN contains(event_type, 'draft') THEN 'info' WHEN contains(event_type, 'delete') THEN 'danger' WHEN contains(event_type, 'letter') THEN 'warning' ELSE 'light' END AS badge, count(*) AS n FROM events GROUP BY ALL""")
def enum02_badges(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", enums.badge(F.col("event_type")).alias("badge")).agg(F.count("*").alias("n"))


@query("""SELECT d.doc_id, round(CASE WHEN l.quality = 1 AND d.text IS NOT NULL THEN (2.0 + 2 * coalesce(l.quality, 0) + 2 * 0.8 + coalesce(1 - l.toxic, 0)) / 7 ELSE least((2.0 + 2 * coalesce(l.quality, 0) + 2 * 0.8 + coalesce(1 - l.toxic, 0)) / 7, 0.69) END, 4) AS confidence,
    CASE WHEN coalesce(l.quality, 0) = 1 AND coalesce(l.toxic, 0) = 0 THEN 'ready' ELSE 'needs_review' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def agg23_confidence(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", F.col("text").isNotNull().alias("has_text")).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    quality = F.coalesce("quality", F.lit(0))
    complete = (quality == 1) & F.col("has_text")
    value = enums.overall_confidence(enums.field_confidence(F.lit("label")), quality, enums.field_confidence(F.lit("unique")), F.coalesce(1 - F.col("toxic"), F.lit(0)), complete)
    status = F.when((quality == 1) & (F.coalesce("toxic", F.lit(0)) == 0), "ready").otherwise("needs_review")
    return own.select("doc_id", value.cast("double").alias("confidence"), status.alias("status"))


@query("""SELECT source, bool_and(coalesce(quality, 0) = 1) AS all_ready, bool_or(coalesce(toxic, 0) = 1) AS any_error FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source""")
def agg26_all_any(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return own.groupBy("source").agg(F.every(F.coalesce("quality", F.lit(0)) == 1).alias("all_ready"), F.some(F.coalesce("toxic", F.lit(0)) == 1).alias("any_error"))
