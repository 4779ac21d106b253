"""Operators on small fixtures with known results."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from fieldroll.functions import dates, enums, numbers
from fieldroll.functions import text as tx
from fieldroll.operators import lines, listings, manpower, progress, tables
from fieldroll.operators.coverage import missing_dates
from fieldroll.operators.revisions import latest
from fieldroll.plans.period_report import MixedProjects, compile_period
from fieldroll.sources import documents as docs

DAY = dt.date


def values(spark, f, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_numbers(spark):
    assert values(spark, numbers.parse_number, ["95,25%", "not a number", "40,5%", "1,234.5", "NaN", "1e999", "1d", " 7 %", None]) == [95.25, None, 40.5, 1234.5, None, None, None, 7.0, None]
    assert values(spark, numbers.parse_number_review, ["40,5%", " ", None, "x"]) == [405.0, 0.0, 0.0, 0.0]
    hours = ["22:00-06:00", "07:00-07:00", "24:00-25:00", "7,5", "1,234.5", "-1", "true", "07:00 – 19:00", None]
    assert values(spark, numbers.parse_hours, hours) == [8.0, 0.0, None, 7.5, None, None, None, 12.0, None]
    words = ["true", "1", "YES", "on", "FALSE", "0", "no", "off", "", "unexpected", None]
    assert values(spark, numbers.parse_bool, words) == [True] * 4 + [False] * 4 + [None] * 3
    assert values(spark, numbers.parse_revision, ["3", "-1", "x", None]) == [3, 0, 0, 0]


def test_names_and_dates(spark):
    assert values(spark, enums.status, ["month-to-date", "approved", "unexpected", None]) == ["MTD", "FINAL", "DRAFT", "DRAFT"]
    got = values(spark, dates.any_date, ["Date 04/08/2026", "Date 4 Agustus 2026", "Date: 2026-06-19 | Day: 2", "13/08/2026", "August 4th, 2026", "31 Feb 2026", None])
    assert got == [None, DAY(2026, 8, 4), DAY(2026, 6, 19), DAY(2026, 8, 13), DAY(2026, 8, 4), None, None]
    assert values(spark, dates.iso_date, ["2026-07-01", "2026-7-1", "2026-02-30", "20260701"]) == [DAY(2026, 7, 1), None, None, None]
    assert values(spark, tx.numbered_item, ["1. Install simulator  ", "- 2) Run", "none"]) == ["Install simulator", "Run", ""]
    assert values(spark, tx.casefold_py, ["  STRAßE  x ", None]) == ["strasse x", None]
    assert values(spark, tx.page_text, ["a b \r\nc\x07﻿"]) == ["a b\nc"]


@pytest.mark.parametrize(
    ("start", "end", "kind", "mode", "problem"),
    [
        ("2026-08-31", "2026-09-02", "weekly", "wtd", None), ("2026-12-28", "2027-01-03", "weekly", "final", None), ("2026-08-04", "2026-08-07", "weekly", "wtd", "start on Monday"),
        ("2026-08-03", "2026-08-10", "weekly", "wtd", "longer than 7 days"), ("2026-08-03", "2026-08-08", "weekly", "draft", "Monday through Sunday"), ("2026-08-31", "2026-09-01", "monthly", "mtd", "one calendar month"),
    ],
)
def test_periods(spark, start, end, kind, mode, problem):
    row = spark.range(1).select(dates.period_problem(F.lit(start).cast("date"), F.lit(end).cast("date"), F.lit(kind), F.lit(mode)).alias("p")).first()
    assert row.p == problem


def record(report_id, date, revision, made, **payload):
    return json.dumps({"record_type": "daily_report", "username": "u", "report_id": report_id, "date": date, "revision": revision, "generated_at": made, "project_no": "P-001", "payload": payload})


def compiled(spark, tmp_path, texts, start, end):
    folder = tmp_path / "u"
    folder.mkdir()
    for k, t in enumerate([*texts, "{broken", '{"record_type": "other"}']):
        (folder / f"{k}.json").write_text(t)
    return compile_period(docs.reports(docs.bronze(spark, str(tmp_path))), start, end, " p-001 ")


def test_revisions_coverage_and_activities(spark, tmp_path):
    area = lambda today, **more: [{"id": "T2", "activities_today": today, **more}]
    gold = compiled(spark, tmp_path, [
        record("day-1-r1", "2026-07-01", 1, "2026-08-01T00:00:00Z", areas=area(["Old activity"], activities_tomorrow=["Do not use this earlier plan"], constraints="Oil seepage")),
        record("day-2-r1", "2026-07-02", 1, "2026-07-02T08:00:00Z", areas=area(["Stale text"])),
        record("day-2-r2", "2026-07-02", 2, "2026-07-02T09:00:00Z", areas=area(["Function test", " function   test "], activities_tomorrow=[["Stroking test"]])),
    ], "2026-07-01", "2026-07-03")
    assert [r.report_id for r in gold["superseded"].collect()] == ["day-2-r1"]
    assert [r.date for r in gold["missing"].collect()] == [DAY(2026, 7, 3)]
    cover = gold["coverage"].first()
    assert (cover.covered_days, cover.missing_days, cover.duplicate_days, cover.is_partial) == (2, 1, 1, True)
    assert [r.activity for r in gold["activities"].orderBy("date", "pos").collect()] == ["Old activity", "Function test"]
    assert [(r.date, r.area_id, r.activity) for r in gold["tomorrow"].collect()] == [(DAY(2026, 7, 2), "T2", "Stroking test")]
    assert [r.activity for r in gold["constraints"].collect()] == ["Oil seepage"]


def person(name, hours):
    return {"name": name, "hours": hours}


def test_headcount_and_hours(spark, tmp_path):
    shift = "07:00 - 17:00"
    gold = compiled(spark, tmp_path, [record("r", "2026-07-30", 1, "2026-07-30T00:00:00Z", indirect_manpower=[person("I1", shift), person("Shared", shift)], areas=[
        {"id": "A", "manpower": [person("Alpha", shift), person("Beta", shift), person("Shared", shift)]},
        {"id": "B", "manpower": [person(" alpha ", "07:00 – 19:00"), person("Beta", "invalid")], "indirect_manpower": [person("I1", shift)]},
    ])], "2026-07-01", "2026-07-31")
    day = gold["manpower_daily"].first()
    assert (day.direct_headcount, day.indirect_headcount, day.total_headcount) == (3, 2, 4)
    assert (day.direct_man_hours, day.indirect_man_hours, day.total_man_hours) == (32.0, 20.0, 42.0)
    assert gold["manpower_totals"].first().total_person_days == 4


def test_shared_person_raises_direct_hours(spark):
    rows = spark.createDataFrame([(1, "direct", "n:p", 0, "", 10.0), (1, "indirect", "n:p", 1, "Lead", 12.0)], "date int, category string, person_key string, row_pos int, role string, hours double")
    day = manpower.daily(manpower.combined(rows, ["date"]), ["date"]).first()
    assert (day.direct_headcount, day.indirect_headcount, day.total_headcount, day.direct_man_hours, day.indirect_man_hours, day.total_man_hours) == (1, 1, 1, 12.0, 12.0, 12.0)


def test_progress(spark):
    schema = "date string, description string, weight string, previous_plan string, previous_actual string, period_plan string, period_actual string, to_date_plan string, to_date_actual string"
    rows = spark.createDataFrame([
        ("2026-07-01", "Commissioning", "40%", "10%", "8%", None, None, "12%", "9%"), ("2026-07-31", " commissioning ", "40", None, None, "999", "999", "30,5%", "28%"),
        ("2026-07-31", "Invalid row", "not-a-number", None, None, None, None, "NaN", None),
    ], schema)
    rows = rows.withColumns({c: numbers.parse_number(F.col(c)) for c in ("weight", *progress.PERCENTS)}).withColumn("deviation", F.lit(None).cast("double"))
    none = F.lit(None).cast("string")
    items = progress.items(rows.withColumn("key", progress.item_key(none, none, none, F.col("description"))), ["date"])
    first = items.where("key = 'commissioning'").first()
    assert (first.period_plan, first.period_actual, first.deviation) == (20.5, 20.0, -2.5)
    total = progress.totals(items).first()
    assert (total.to_date_plan, total.to_date_actual, total.deviation) == (12.2, 11.2, -1.0)


def test_review_total_row(spark):
    rows = spark.createDataFrame([("a", 25.0, 40.0, 4.0, 50.0), ("b", 50.0, 20.0, 10.0, 40.0)], "label string, weight double, previous double, this double, plan double")
    t = progress.with_total_row(rows, "label").where("is_total").first()
    assert (t.weight, t.previous, t.this, t.to_date, t.plan, t.variance) == (75.0, 20.0, 6.0, 26.0, 32.5, -6.5)


def test_page_text_to_fields(spark):
    page = "\n".join(["1. REPORT INFORMATION", "Project No.        PC-TEST-001", "Date               2026-07-28", "Working Day        Day 403", "■ Unit 2", "Activity Today".ljust(40) + "Activity Tomorrow", "1. Install simulator".ljust(40) + "1. Run stroking test"])
    rows = lines.line_rows(spark.createDataFrame([(1, page)], "id int, t string"), "id", "t")
    got = lines.extract(rows, {"project_no": (r"Project No\.?",), "date": ("Date",)}).first()
    assert (got.project_no, got.date) == ("PC-TEST-001", "2026-07-28")
    left, right = lines.two_columns(F.col("text"), F.lit(41))
    pair = rows.where("line_no = 7").select(tx.numbered_item(left).alias("a"), tx.numbered_item(right).alias("b")).first()
    assert tuple(pair) == ("Install simulator", "Run stroking test")
    assert lines.segments(rows, F.startswith("text", F.lit("■"))).where("segment = 1").count() == 3


def test_order_and_partitions_change_nothing(spark, sf_dir):
    from fieldroll.operators.revisions import latest

    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("d", F.to_date("ts"))
    args = (["user_id", "d"], ["value", "ts", "event_id"])
    assert sorted(latest(events, *args).collect()) == sorted(latest(events.repartition(7).orderBy(F.rand(3)), *args).collect())


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "k string, date date, v double")
    assert missing_dates(none, "2024-01-01", "2024-01-03", ["k"]).count() == 0
    assert tables.upsert(none, none, ["k"]).count() == 0
    assert tables.latest_only(none, [], "date").count() == 0


def test_streams(spark, tmp_path, sf_dir):
    from fieldroll.operators.revisions import latest
    from fieldroll.sources.keyed import KeyedTable
    from fieldroll.streaming.revisions import upsert_stream

    source = str(tmp_path / "in")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "value")
    events.write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    store = KeyedTable(spark, str(tmp_path / "out"), "user_id long, event_id long, value double", ["user_id"])
    upsert_stream(stream, store, ["value", "event_id"], str(tmp_path / "cp")).awaitTermination()
    assert sorted(store.read().collect()) == sorted(latest(events, ["user_id"], ["value", "event_id"]).collect())


def test_array_files_and_file_lists(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"name": "x", "n": 1}, {"name": "y"}]')
    (tmp_path / "b.json").write_text("[broken")
    rows = docs.array_files(spark, str(tmp_path), "name string, n int").orderBy("position").collect()
    assert [(r.position, r.name, r.n) for r in rows] == [(0, "x", 1), (1, "y", None)]
    assert [(r.name, r.size_bytes) for r in docs.file_list(spark, str(tmp_path), r"b\.json").collect()] == [("b.json", 7)]


def test_as_list(spark):
    docs = ["null", '""', '"a"', "[1, null]", "[]", "7", '{"k": 1}', None]
    rows = spark.createDataFrame([(k, d) for k, d in enumerate(docs)], "k int, d string")
    own = rows.select("k", F.transform(listings.as_list(F.parse_json("d")), lambda x: F.to_json(x)).alias("x")).orderBy("k").collect()
    assert [r.x for r in own] == [[], [], ['"a"'], ["1", "null"], [], ["7"], ['{"k":1}'], []]


def test_snapshot_time(spark):
    names = ["20240229_235959.json", "20230229_000000.json", None]
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string")
    assert [r.t for r in rows.select("k", dates.snapshot_time(F.col("n")).alias("t")).orderBy("k").collect()] == ["29 Feb 2024 23:59:59", "20230229_000000", None]


def reports_of(spark, tmp_path, rows):
    (tmp_path / "u").mkdir()
    for k, (number, title, date, payload) in enumerate(rows):
        own = json.loads(record(f"r{k}", date, 1, "2026-07-30T00:00:00Z", **payload)) | {"project_no": number, "project_title": title}
        (tmp_path / "u" / f"{k}.json").write_text(json.dumps(own))
    return docs.reports(docs.bronze(spark, str(tmp_path)))


def progress_row(**more):
    return {"overall_progress": [{"item_id": "A", "weight_factor": "50%", "cumulative_previous_plan": 1, **more}, {"description": "  "}, "no row"]}


def test_projects_apart(spark, tmp_path):
    reports = reports_of(spark, tmp_path, [
        ("P-1", "One", "2026-07-01", progress_row(cumulative_to_date_plan="4%") | {"areas": [{"manpower": [person("A", 8)], "constraints": [["Wet", ["wet "]]]}, 7]}),
        ("P-1", "One", "2026-07-03", progress_row(cumulative_to_date_plan=9, cumulative_to_date_actual="7,5") | {"areas": []}),
        ("P-2", "Two", "2026-07-01", progress_row(cumulative_to_date_plan=2) | {"areas": [{"id": " B  1", "manpower": [person("a", 9), person("", None)]}]}),
        ("P-2", "Two", "2026-07-02", progress_row() | {"show_overall_progress": "off"}),
        ("", "", "2026-07-02", {}),
    ])
    with pytest.raises(MixedProjects):
        compile_period(reports, "2026-07-01", "2026-07-03", mixed="refuse")
    gold = compile_period(reports, "2026-07-01", "2026-07-03")
    days = {(r.project_key, r.date.day): (r.total_headcount, r.total_man_hours) for r in gold["manpower_daily"].collect()}
    assert days == {("p-1", 1): (1, 8.0), ("p-1", 3): (0, 0.0), ("p-2", 1): (1, 9.0), ("p-2", 2): (0, 0.0), ("", 2): (0, 0.0)}
    items = {r.project_key: (r.key, r.period_plan, r.deviation, r.first_source_date.day, r.last_source_date.day) for r in gold["progress"].collect()}
    assert items == {"p-1": ("id:a", 8.0, -1.5, 1, 3), "p-2": ("id:a", 1.0, None, 1, 1)}
    assert [(r.area_id, r.activity) for r in gold["constraints"].collect()] == [("Unspecified", "Wet")]
    cover = {r.project_key: (r.covered_days, r.missing_days) for r in gold["coverage"].collect()}
    assert cover == {"p-1": (2, 1), "p-2": (2, 1), "": (1, 2)}
    assert gold.counters == {"reports": 5, "without_date": 0, "outside": 0, "other_projects": 0, "in_period": 5}
    one = compile_period(reports, "2026-07-01", "2026-07-03", project_no="p-1", expected_dates=["2026-07-02", "2026-07-03"])
    assert [(r.covered_days, r.missing_days, r.extra_days) for r in one["coverage"].collect()] == [(2, 1, 1)]
    assert one.counters["other_projects"] == 3 and [r.date.day for r in one["extra"].collect()] == [1]
    with pytest.raises(ValueError):
        compile_period(reports, "2026-07-01", "2026-07-03", expected_dates=["2026-08-01"])


def test_reports_without_project_join_the_only_one(spark, tmp_path):
    gold = compile_period(reports_of(spark, tmp_path, [("P-1", "One", "2026-07-01", {}), ("", "", "2026-07-02", {})]), "2026-07-01", "2026-07-02", mixed="refuse")
    assert [(r.project_key, r.title_key, r.covered_days) for r in gold["coverage"].collect()] == [("p-1", "one", 2)]


def flattened(value):
    if isinstance(value, str):
        return [" ".join(value.split())] if value.strip() else []
    return [x for v in value for x in flattened(v)] if isinstance(value, list) else []


def test_texts_of_any_depth(spark):
    deep = "x"
    for _ in range(12):
        deep = [deep, " ", None, {"a": ["no"]}]
    values = ["one  two", 5, None, [], [[]], ["a", ["b", ["c", {"d": "}{\\\""}, 7, True]], "é\"\\\n{"], deep, {"x": "no"}, "y" * 30_000, ["\\\"" * 5000]]
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(values)], "k int, t string")
    own = {r.k: r.x for r in rows.select("k", docs.texts(F.parse_json("t")).alias("x")).collect()}
    assert own == {k: flattened(v) for k, v in enumerate(values)}


def test_compile_reads_reports_once(spark, tmp_path):
    gold = compile_period(reports_of(spark, tmp_path, [("P-1", "One", "2026-07-01", {})]), "2026-07-01", "2026-07-02")
    for name, df in gold.tables.items():
        assert ("/u" in "".join(df.inputFiles())) == (name == "superseded")


def test_totals_in_one_aggregation(spark):
    schema = "kind string, label string, weight double, previous double, this double, plan double"
    rows = spark.createDataFrame([("x", "a", 25.0, 40.0, 4.0, 50.0), ("x", "a", 25.0, 40.0, 4.0, 50.0), ("x", None, -3.0, 1.0, 1.0, 1.0), (None, "b", 0.0, 1.0, 2.0, 3.0), ("y", "c", 10.0, None, 1.0, 2.0)], schema)
    out = progress.with_total_row(rows, "label", ["kind"])
    got = sorted(((r.kind, r.label, r.weight, r.previous, r.this, r.to_date, r.is_total) for r in out.collect()), key=str)
    detail = [("x", "a", 25.0, 40.0, 4.0, 44.0, False)] * 2 + [("x", None, 0.0, 1.0, 1.0, 2.0, False), (None, "b", 0.0, 1.0, 2.0, 3.0, False), ("y", "c", 10.0, None, 1.0, None, False)]
    assert got == sorted([*detail, ("x", "Total", 50.0, 20.0, 2.0, 22.0, True), ("y", "Total", 10.0, None, 0.1, None, True)], key=str)
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Union" not in plan
