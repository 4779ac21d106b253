"""Records from page text."""

import datetime as dt

import pytest

from fieldroll.plans.page_import import import_pages

PAD = 40
BODY = [
    "1. REPORT INFORMATION", "Project No.        PC-TEST-001", "Project Name       Sample Project", "Customer           Sample Customer", "Location           Site", "Equipment          Unit 2",
    "Date               2026-07-28", "Working Day        Day 403", "4. DAILY ACTIVITIES & MANPOWER BY AREA", "■ Unit 2", "Activity Today".ljust(PAD) + "Activity Tomorrow",
    "1. Install simulator".ljust(PAD) + "1. Run stroking test", "2. Connect signal cable".ljust(PAD) + "2. Verify permissive interlock", "5. CONSTRAINTS & ISSUES", "No constraints reported.", "6. REMARKS", "Sample remarks only.",
]


def imported(spark, *pages, known=(("project-test-001", "Sample Project", "PC-TEST-001"),)):
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate(pages, 1)], "doc_id int, page int, text string")
    return import_pages(rows, spark.createDataFrame(list(known), "project_id string, title string, project_no string"))


def changed(**lines):
    return "\n".join(next((new for old, new in lines.items() if line.startswith(old)), line) for line in BODY)


def codes(out):
    return {r.code for r in out["warnings"].collect()}


def test_whole_page(spark):
    out = imported(spark, "\n".join(BODY))
    r = out["records"].first()
    assert (r.status, r.review_required, r.project_id, r.date, r.day_no) == ("ready", True, "project-test-001", dt.date(2026, 7, 28), "403")
    assert (r.customer, r.location, r.equipment, r.global_remarks, r.confidence) == ("Sample Customer", "Site", "Unit 2", "Sample remarks only.", 1.0)
    items = [(x.area_id, x.kind, x.activity) for x in out["activities"].orderBy("kind", "line_no").collect()]
    assert items == [("Unit 2", "today", "Install simulator"), ("Unit 2", "today", "Connect signal cable"), ("Unit 2", "tomorrow", "Run stroking test"), ("Unit 2", "tomorrow", "Verify permissive interlock")]
    assert codes(out) == set()
    assert {x.section: x.text for x in out["sections"].collect()}["constraints"] == "No constraints reported."


@pytest.mark.parametrize(
    ("line", "date", "found"),
    [
        ("Date 04/08/2026", None, {"ambiguous_numeric_date", "missing_date"}), ("Date 4 Agustus 2026", dt.date(2026, 8, 4), set()), ("Date: 2026-06-19 | Day: 2 | Project: x", dt.date(2026, 6, 19), set()),
        ("Datum 2026-06-19", dt.date(2026, 6, 19), {"date_inferred_without_label"}), ("Date 2026-02-30", None, {"invalid_date", "missing_date"}), ("2026-06-19 and 2026-06-20", None, {"ambiguous_date_candidates", "missing_date"}),
    ],
)
def test_dates(spark, line, date, found):
    out = imported(spark, changed(Date=line))
    r = out["records"].first()
    assert (r.date, codes(out)) == (date, found)
    assert (r.status == "ready") == (date is not None)


def test_projects(spark):
    title_only = imported(spark, changed(**{"Project No": "Projekt"}))
    r = title_only["records"].first()
    assert (r.project_no, r.project_id, r.status) == (None, None, "needs_review")
    s = title_only["suggestions"].first()
    assert (s.known_id, s.score, s.confident) == ("project-test-001", 100.0, True)
    number_only = imported(spark, changed(**{"Project Name": "-"}))["records"].first()
    assert (number_only.project_title, number_only.title_method) == ("Sample Project", "master")
    other = imported(spark, changed(**{"Project Name": "Project Name  Another"}))
    assert codes(other) == {"project_title_master_mismatch"}
    twice = imported(spark, "\n".join(BODY), known=[("a", "A", "PC-TEST-001"), ("b", "B", " pc-test-001 ")])
    assert codes(twice) == {"ambiguous_exact_project_number"}


def test_lists_below_each_other_and_values_on_the_next_line(spark):
    page = "\n".join(["Project No.", "", "PC-TEST-001", "Day 7", "Date", "Customer", "4. DAILY ACTIVITIES AND MANPOWER BY AREA", "Activity Today", "1. One", "Activity Tomorrow", "- 2) Two", "Direct Manpower", "3. Three"])
    out = imported(spark, page)
    r = out["records"].first()
    assert (r.project_no, r.date, r.day_no, r.day_method) == ("PC-TEST-001", None, "7", "unique")
    assert [(x.area_id, x.kind, x.activity) for x in out["activities"].orderBy("line_no").collect()] == [("Imported PDF", "today", "One"), ("Imported PDF", "tomorrow", "Two")]


def test_blank_and_empty(spark):
    out = imported(spark, "", " \n ")
    assert out["records"].first().status == "needs_review" and "no_extractable_text" in codes(out)
    none = import_pages(spark.createDataFrame([], "doc_id int, page int, text string"), spark.createDataFrame([], "project_id string, title string, project_no string"))
    assert all(df.count() == 0 for df in none.values())
