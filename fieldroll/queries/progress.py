"""Cumulative series and weighted totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import progress
from ..registry import query, table


@query("""WITH f AS (SELECT user_id, event_type, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY ALL)
    SELECT user_id, event_type, first_value, last_value, round(last_value - first_value, 6) AS delta FROM f""")
def agg13_first_last_delta(spark, sf_dir):
    own = progress.first_and_last(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["value"])
    delta = progress.period_delta(F.col("last_value"), F.col("first_value"), F.lit(None).cast("double"))
    return own.withColumn("delta", F.round(delta, 6))


#: A line item is a progress row of its part: the weight is the quantity, percents come from discount and tax.
ROWS_SQL = """WITH r AS (SELECT CAST(l_partkey AS VARCHAR) AS key, CAST(l_shipdate AS DATE) AS date, l_orderkey * 100 + l_linenumber AS pos, l_suppkey, l_quantity AS weight, round(l_discount * 100) AS previous_plan, round(l_tax * 100) AS previous_actual, round(l_discount * 100) + 30 AS to_date_plan, round(l_tax * 100) + 25 AS to_date_actual FROM lineitem),
    f AS (SELECT key, arg_max(weight, (date, pos, l_suppkey)) AS weight, arg_min(previous_plan, (date, pos, l_suppkey)) AS previous_plan, arg_min(previous_actual, (date, pos, l_suppkey)) AS previous_actual, arg_max(to_date_plan, (date, pos, l_suppkey)) AS to_date_plan, arg_max(to_date_actual, (date, pos, l_suppkey)) AS to_date_actual FROM r GROUP BY key),
    i AS (SELECT *, to_date_plan - previous_plan AS period_plan, to_date_actual - previous_actual AS period_actual FROM f)"""


def items(spark, sf_dir):
    plan, actual = F.round(F.col("l_discount") * 100), F.round(F.col("l_tax") * 100)
    none = F.lit(None).cast("double")
    rows = table(spark, sf_dir, "lineitem").select(
        progress.item_key(F.lit(""), F.lit(None).cast("string"), F.col("l_partkey").cast("string"), F.lit("unused")).alias("key"),
        F.to_date("l_shipdate").alias("date"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("pos"), "l_suppkey",
        F.lit("").alias("description"), F.col("l_quantity").alias("weight"), plan.alias("previous_plan"), actual.alias("previous_actual"),
        none.alias("period_plan"), none.alias("period_actual"), (plan + 30).alias("to_date_plan"), (actual + 25).alias("to_date_actual"), none.alias("deviation"),
    )
    return progress.items(rows, ["date", "pos", "l_suppkey"])


@query(ROWS_SQL + "SELECT key, weight, previous_plan, previous_actual, period_plan, period_actual, to_date_plan, to_date_actual, to_date_actual - to_date_plan AS deviation FROM i")
def agg14_period_items(spark, sf_dir):
    return items(spark, sf_dir).drop("description")


@query(ROWS_SQL + """SELECT sum(weight) AS weight, round(sum(weight * previous_plan / 100), 6) AS previous_plan, round(sum(weight * previous_actual / 100), 6) AS previous_actual, round(sum(weight * period_plan / 100), 6) AS period_plan, round(sum(weight * period_actual / 100), 6) AS period_actual,
    round(sum(weight * to_date_plan / 100), 6) AS to_date_plan, round(sum(weight * to_date_actual / 100), 6) AS to_date_actual, round(sum(weight * to_date_actual / 100) - sum(weight * to_date_plan / 100), 6) AS deviation FROM i""")
def agg15_weighted_totals(spark, sf_dir):
    return progress.totals(items(spark, sf_dir))


REVIEW_SQL = """WITH d AS (SELECT l_linestatus AS kind, l_returnflag AS label, sum(l_quantity) AS weight, round(sum(l_discount * 100)) AS previous, round(sum(l_tax * 100)) AS this, round(sum(l_tax * 100)) + 7 AS plan FROM lineitem GROUP BY ALL),
    t AS (SELECT kind, label, weight, previous, this, previous + this AS to_date, plan, false AS is_total FROM d
    UNION ALL SELECT kind, 'Total', sum(weight), round(sum(weight * previous / 100), 4), round(sum(weight * this / 100), 4), round(sum(weight * previous / 100) + sum(weight * this / 100), 4), round(sum(weight * plan / 100), 4), true FROM d GROUP BY kind HAVING sum(weight) > 0)"""


def review(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("kind"), F.col("l_returnflag").alias("label"))
    this = F.round(F.sum(F.col("l_tax") * 100))
    rows = own.agg(F.sum("l_quantity").alias("weight"), F.round(F.sum(F.col("l_discount") * 100)).alias("previous"), this.alias("this"), (this + 7).alias("plan"))
    return progress.with_total_row(rows, "label", ["kind"])


@query(REVIEW_SQL + "SELECT *, round(to_date - plan, 4) AS variance FROM t")
def agg18_review_total_row(spark, sf_dir):
    return review(spark, sf_dir)


@query(REVIEW_SQL + "SELECT 'Previous,This period,To date' AS labels, round(previous, 2) AS first, round(to_date, 2) AS last, CAST(ceil(greatest(to_date, plan) / 20) * 20 AS BIGINT) AS top FROM t WHERE is_total ORDER BY kind DESC LIMIT 1")
def agg27_s_curve(spark, sf_dir):
    own = progress.s_curve(review(spark, sf_dir), "kind")
    return own.select(F.array_join("labels", ",").alias("labels"), F.round(F.get("actual", F.lit(0)), 2).alias("first"), F.round(F.get("actual", F.lit(2)), 2).alias("last"), F.col("top").cast("long").alias("top"))


@query("""WITH o AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS lost, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS hours, count(*) FILTER (o_orderstatus = 'P') AS cases FROM orders GROUP BY o_custkey)
    SELECT c_custkey, CASE WHEN coalesce(hours, 0) = 0 THEN 0 ELSE round(lost * 1000000.0 / hours, 2) END AS severity, CASE WHEN coalesce(cases, 0) = 0 THEN 0 ELSE round(lost * 1.0 / cases, 2) END AS average FROM customer LEFT JOIN o ON c_custkey = o_custkey""")
def agg19_safe_ratios(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("lost"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("hours"),
        F.count_if(F.col("o_orderstatus") == "P").alias("cases"),
    )
    own = table(spark, sf_dir, "customer").select("c_custkey").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return own.select("c_custkey", numbers.safe_ratio(F.col("lost"), F.col("hours"), 1e6).alias("severity"), numbers.safe_ratio(F.col("lost"), F.col("cases")).alias("average"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CAST(l_tax * 100 AS DOUBLE), 2) AS a, CAST(round(l_extendedprice, 2) AS DOUBLE) AS b, CAST(NULL AS DOUBLE) AS c FROM lineitem""")
def num02_number(spark, sf_dir):
    price = F.format_string("%,.2f", "l_extendedprice")
    tax = F.replace(F.format_string(" %.2f %%", F.col("l_tax") * 100), F.lit("."), F.lit(","))
    parse = numbers.parse_number
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", parse(tax).alias("a"), parse(price).alias("b"), parse(F.concat(F.lit("no "), "l_returnflag")).alias("c"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_tax * 10000) AS DOUBLE) AS a, 0.0::DOUBLE AS b FROM lineitem""")
def num03_number_review(spark, sf_dir):
    tax = F.replace(F.format_string("%.2f%%", F.col("l_tax") * 100), F.lit("."), F.lit(","))
    parse = numbers.parse_number_review
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", parse(tax).alias("a"), parse(F.lit("  ")).alias("b"))


@query("SELECT event_id, greatest(0, coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(floor(value) AS INTEGER) - 50 END, 0)) AS revision FROM events")
def num05_revision(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, "none").otherwise((F.floor("value").cast("int") - 50).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", numbers.parse_revision(text).alias("revision"))


@query("SELECT doc_id, round(strlen(text) / 1024.0, 1) AS size_kb FROM documents")
def num09_size(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", numbers.size_kb(F.octet_length("text")).alias("size_kb"))


@query("SELECT o_orderkey, CASE o_orderpriority[1] WHEN '1' THEN true WHEN '2' THEN false END AS flag FROM orders")
def flt09_bool(spark, sf_dir):
    first = F.substring("o_orderpriority", 1, 1)
    word = F.when(first == "1", " Yes ").when(first == "2", "OFF").otherwise(F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.parse_bool(word).alias("flag"))
