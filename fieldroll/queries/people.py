"""Headcounts and man-hours: a line item stands for an assignment of its supplier on its ship date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import manpower
from ..registry import query, table

#: Hours are quantities modulo 24, so they are exact; the role is the return flag.
PEOPLE_SQL = """WITH r AS (SELECT CAST(l_shipdate AS DATE) AS date, CASE WHEN l_linestatus = 'O' THEN 'direct' ELSE 'indirect' END AS category, 'n:supplier ' || l_suppkey AS person_key, l_quantity % 24 AS hours, l_returnflag AS role, l_orderkey * 100 + l_linenumber AS pos FROM lineitem),
    p AS (SELECT date, category, person_key, max(hours) AS hours, arg_min(role, (pos, role)) AS role FROM r GROUP BY ALL),
    m AS (SELECT coalesce(d.date, i.date) AS date, coalesce(d.person_key, i.person_key) AS person_key, d.date IS NOT NULL AS is_direct, i.date IS NOT NULL AS is_indirect,
          CASE WHEN d.date IS NOT NULL THEN greatest(d.hours, i.hours) END AS direct_hours, i.hours AS indirect_hours, greatest(d.hours, i.hours) AS hours, CASE WHEN d.date IS NOT NULL THEN d.role ELSE i.role END AS role
          FROM (FROM p WHERE category = 'direct') d FULL JOIN (FROM p WHERE category = 'indirect') i ON d.date = i.date AND d.person_key = i.person_key)"""
DAILY_SQL = """SELECT date, count(*) FILTER (is_direct) AS direct_headcount, count(*) FILTER (is_indirect) AS indirect_headcount, count(*) AS total_headcount,
    coalesce(round(sum(direct_hours), 2), 0) AS direct_man_hours, coalesce(round(sum(indirect_hours), 2), 0) AS indirect_man_hours, coalesce(round(sum(hours), 2), 0) AS total_man_hours, count(*) FILTER (hours IS NULL) AS unparsed_hours_count FROM m GROUP BY date"""


def assignments(spark, sf_dir) -> DataFrame:
    name = F.concat(F.lit("  Supplier "), F.col("l_suppkey"))
    category = F.when(F.col("l_linestatus") == "O", "direct").otherwise("indirect")
    position = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("date"),
        category.alias("category"),
        manpower.person_key(name, category, position).alias("person_key"),
        numbers.parse_hours((F.col("l_quantity") % 24).cast("string")).alias("hours"),
        F.col("l_returnflag").alias("role"),
        F.struct(position, "l_returnflag").alias("row_pos"),
    )


def combined(spark, sf_dir) -> DataFrame:
    return manpower.combined(assignments(spark, sf_dir), ["date"])


@query("SELECT date, direct_headcount, indirect_headcount, total_headcount FROM (" + PEOPLE_SQL + DAILY_SQL + ")")
def agg04_daily_headcount(spark, sf_dir):
    return manpower.daily(combined(spark, sf_dir), ["date"]).select("date", "direct_headcount", "indirect_headcount", "total_headcount")


@query(PEOPLE_SQL + DAILY_SQL)
def agg07_daily_hours(spark, sf_dir):
    return manpower.daily(combined(spark, sf_dir), ["date"])


@query(PEOPLE_SQL + "SELECT date, person_key, is_direct, is_indirect, direct_hours, indirect_hours, hours, role FROM m")
def join13_direct_indirect_merge(spark, sf_dir):
    return combined(spark, sf_dir)


@query(PEOPLE_SQL + ", d AS (" + DAILY_SQL + """) SELECT CAST(sum(total_headcount) AS BIGINT) AS total_person_days, round(sum(direct_man_hours), 2) AS direct_man_hours, round(sum(indirect_man_hours), 2) AS indirect_man_hours, round(sum(total_man_hours), 2) AS total_man_hours,
    max(total_headcount) AS peak_headcount, CAST(sum(unparsed_hours_count) AS BIGINT) AS unparsed_hours_count FROM d""")
def agg09_period_totals(spark, sf_dir):
    return manpower.totals(manpower.daily(combined(spark, sf_dir), ["date"]))


@query(PEOPLE_SQL + ", d AS (" + DAILY_SQL + ") SELECT date_trunc('month', date)::DATE AS month, max(total_headcount) AS peak_headcount, CAST(sum(total_headcount) AS BIGINT) AS person_days FROM d GROUP BY ALL")
def agg10_monthly_peak(spark, sf_dir):
    days = manpower.daily(combined(spark, sf_dir), ["date"]).withColumn("month", F.trunc("date", "MM"))
    return manpower.totals(days, ["month"]).select("month", "peak_headcount", F.col("total_person_days").alias("person_days"))


@query(PEOPLE_SQL + "SELECT lower(role) AS role_key, min(role) AS role, count(*) AS person_days, round(sum(hours), 2) AS man_hours, count(*) FILTER (hours IS NULL) AS unparsed_hours_count FROM m GROUP BY lower(role)")
def agg11_role_summary(spark, sf_dir):
    return manpower.roles(combined(spark, sf_dir), ["date", "person_key"])


@query("""SELECT l_orderkey, count(DISTINCT CASE WHEN l_linenumber % 3 = 0 THEN 'a:direct:' || l_linenumber || ':' || l_partkey ELSE 'n:supplier ' || l_suppkey END) AS people FROM lineitem GROUP BY l_orderkey""")
def ded02_people(spark, sf_dir):
    name = F.when(F.col("l_linenumber") % 3 == 0, "  ").otherwise(F.concat(F.lit("SUPPLIER   "), F.col("l_suppkey")))
    key = manpower.person_key(name, F.lit("direct"), F.concat_ws(":", "l_linenumber", "l_partkey"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_distinct(key).alias("people"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS INTEGER) % 24 AS a, l_partkey % 60 AS m, CAST(l_suppkey % 26 AS INTEGER) AS b FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN b > 23 THEN NULL ELSE round(((b * 60 - a * 60 - m) % 1440 + 1440) % 1440 / 60.0, 4) END AS hours FROM t""")
def num01_hours(spark, sf_dir):
    a, m, b = F.col("l_quantity").cast("int") % 24, F.col("l_partkey") % 60, (F.col("l_suppkey") % 26).cast("int")
    shift = F.format_string("shift %02d:%02d – %02d:00", a, m, b)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(numbers.parse_hours(shift), 4).alias("hours"))
