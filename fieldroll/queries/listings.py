"""Ranks, listings, series over dates, and formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import enums, numbers
from ..functions import text as tx
from ..operators import listings as ls
from ..operators import manpower, progress
from ..operators import revisions as rv
from ..registry import query, table


@query("""WITH r AS (SELECT l_orderkey, l_linenumber % 2 AS category, l_suppkey AS person_key, (l_linenumber, l_partkey, l_returnflag) AS pos, l_quantity AS hours, CASE WHEN l_linenumber % 3 <> 0 THEN l_returnflag END AS role FROM lineitem)
SELECT l_orderkey, category, person_key, max(hours) AS hours, arg_min(role, pos) FILTER (role IS NOT NULL) AS role FROM r GROUP BY ALL""")
def agg05_longest_shift(spark, sf_dir):
    role = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_returnflag")).otherwise("  ").alias("role")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 2).alias("category"), F.col("l_suppkey").alias("person_key"), F.struct("l_linenumber", "l_partkey", "l_returnflag").alias("row_pos"), F.col("l_quantity").alias("hours"), role)
    return manpower.people(rows, ["l_orderkey"])


@query("""WITH i AS (SELECT o_custkey, year(o_orderdate) AS year, max(o_orderkey) AS revision FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
    SELECT o_orderkey, coalesce(revision, 0) + 1 AS next_revision FROM orders LEFT JOIN i ON orders.o_custkey = i.o_custkey AND year(o_orderdate) = i.year WHERE o_orderstatus <> 'F'""")
def agg21_next_revision_of_period(spark, sf_dir):
    """One more than the largest revision that the index holds of the period; finished orders stand for it, their keys for revisions."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"), "o_orderstatus")
    following = rv.next_number(orders.where("o_orderstatus = 'F'"), ["o_custkey", "year"], F.col("o_orderkey"))
    rows = orders.where("o_orderstatus <> 'F'").join(following, ["o_custkey", "year"], "left")
    return rows.select("o_orderkey", F.coalesce("next_revision", F.lit(1)).cast("long").alias("next_revision"))


@query("""SELECT o_orderpriority, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses FROM orders GROUP BY o_orderpriority""")
def agg29_listed_by_role(spark, sf_dir):
    rows = ls.listed(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus")
    return rows.select("o_orderpriority", F.array_join("o_orderstatus", ",").alias("statuses"))


@query("""SELECT l_suppkey, CAST(greatest(n - 40, 0) AS INTEGER) AS more, array_to_string(ids[1:40], ',') AS first FROM (SELECT l_suppkey, count(DISTINCT l_partkey) AS n, list_sort(list(DISTINCT l_partkey)) AS ids FROM lineitem GROUP BY l_suppkey)""")
def top09_first_40_and_more(spark, sf_dir):
    rows = ls.listed(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_partkey", 40)
    return rows.select("l_suppkey", "more", F.array_join(F.transform("l_partkey", lambda x: x.cast("string")), ",").alias("first"))


@query("""SELECT arg_min(c_name, c_custkey) AS c_name, c_nationkey, min(c_custkey) AS c_custkey FROM customer GROUP BY lower(c_mktsegment), c_nationkey""")
def ded04_project_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return rv.first_per_key(rows, [F.lower("c_mktsegment"), F.col("c_nationkey")], ["c_custkey"]).select("c_name", "c_nationkey", "c_custkey")


@query("""SELECT l_orderkey, l_linenumber, l_quantity, l_quantity - second AS margin FROM (SELECT *, row_number() OVER w AS n, lead(l_quantity) OVER w AS second FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber)) WHERE n = 1""")
def win03_margin(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return ls.with_margin(rows, ["l_orderkey"], "l_quantity", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS INTEGER) AS number FROM lineitem WHERE l_returnflag <> 'N'")
def win08_renumbered_sections(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return ls.renumbered(rows, ["l_orderkey"], "l_linenumber", F.col("l_returnflag") != "N").drop("l_returnflag")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20")
def top06_newest_20(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return rv.newest(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")], 20).select("user_id", "event_id")


@query("SELECT user_id, CAST(ts AS DATE) AS date FROM events UNION SELECT o_custkey, CAST(o_orderdate AS DATE) FROM orders")
def set04_union_distinct(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("date"))
    return events.union(table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate"))).distinct()


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice / 2 ELSE o_totalprice - o_custkey END AS deviation FROM orders""")
def num06_deviation(spark, sf_dir):
    plan = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey").cast("double"))
    return table(spark, sf_dir, "orders").select("o_orderkey", progress.deviation(F.col("o_totalprice"), plan, F.col("o_totalprice") / 2).alias("deviation"))


@query("SELECT l_orderkey, l_linenumber, printf('%.1f%%', l_quantity) AS percent FROM lineitem")
def num04_percent_text(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.percent_text(F.col("l_quantity")).alias("percent"))


@query("SELECT s_suppkey, replace(replace(replace('<' || s_name || ' & co>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM supplier")
def str10_escaped(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", tx.escape_markup(F.concat(F.lit("<"), "s_name", F.lit(" & co>"))).alias("escaped"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'Pressed' WHEN 'view' THEN 'Seen' ELSE 'Other' END AS label FROM events")
def enum03_letter_label(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", enums.chosen(F.col("event_type"), {"click": "Pressed", "view": "Seen"}, "Other").alias("label"))


@query("SELECT page_id, sha256(coalesce(html, '')) AS digest FROM pages")
def hsh01_content_digest(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("digest"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%d %b %Y') AS shown, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday, date_trunc('month', o_orderdate)::DATE AS month FROM orders")
def dat08_shown_date(spark, sf_dir):
    date = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(date, "dd MMM yyyy").alias("shown"), F.weekday(date).alias("weekday"), F.trunc(date, "month").alias("month"))


@query("SELECT c_nationkey, upper(c_mktsegment) || ': ' || c_name AS warning, count(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY ALL")
def ded03_warnings(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").where("c_acctbal < 0")
    return rows.groupBy("c_nationkey", F.concat(F.upper("c_mktsegment"), F.lit(": "), "c_name").alias("warning")).agg(F.count("*").alias("n"))
