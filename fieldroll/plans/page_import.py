"""From the text of pages to reviewable records: labelled fields, sections, areas and their activities, warnings, confidence.

Documents are keyed by doc_id throughout; every step is a window or an aggregation within one document's lines.
Whatever can't be read for certain is left empty and becomes a warning; nothing is filled in by similarity alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.likeness import likeliest
from ..functions import dates, enums
from ..functions import text as tx
from ..operators import lines as ln
from ..operators import matching

#: How fields are labelled.
LABELS = {
    "project_no": (r"Project\s*(?:No\.?|Number)", r"Vendor\s+Project\s+No\.?", r"Contract\s+No\.?"),
    "project_title": (r"Project\s*(?:Name|Title)",),
    "customer": ("(?:Customer|Client)",),
    "location": ("(?:Location|Site)",),
    "equipment": ("Equipment",),
    "date": (r"(?:Report\s+)?Date",),
    "day_no": (r"(?:Working\s+Day|Day\s*(?:No\.?|Number))",),
}
ANY_LABEL = "|".join(p for of in LABELS.values() for p in of)
#: What ends a date that shares its line, and what a day's number looks like.
DATE_END = r"\s*\|\s*(?:Day\b|Working\s+Day\b|Project\b).*$"
DAY_NUMBER = r"(?i)^(?:Day\s*)?(\d{1,6})$"

#: The sections' headings.
SECTIONS = {
    "REPORT INFORMATION": "report_information",
    "WEATHER REPORT": "weather",
    "WEATHER STATUS": "weather",
    "INDIRECT MANPOWER": "indirect_manpower",
    "OVERALL PROGRESS": "overall_progress",
    "DAILY ACTIVITIES AND MANPOWER BY AREA": "daily_activities",
    "CONSTRAINTS AND ISSUES": "constraints",
    "REMARKS": "remarks",
    "SIGN OFF": "sign_off",
    "PHOTO DOCUMENTATION": "photo_documentation",
    "THIS MONTH ACTIVITIES": "this_month_activities",
    "PLANNED ACTIVITIES NEXT MONTH": "planned_activities_next_month",
    "AREA OF CONCERN AND SUGGESTED CORRECTIVE ACTION": "area_of_concern",
}
HEADING = r"^\d+(?:\.\d+)*\s*[.)]?\s+(.+)$"
AREA = r"^\s*[■▪●□]\s*(.+?)\s*$"
AREA_END = r"(?i)\b(?:Direct|Indirect)\s+Manpower\b|^\s*(?:Constraints|Remarks)\s*:"


def page_lines(pages: DataFrame) -> DataFrame:
    """doc_id, page, line_no, text and compact (white space collapsed). pages: doc_id, page, text."""
    own = pages.select("doc_id", "page", tx.page_text(F.col("text")).alias("text"))
    compact = F.regexp_replace("text", r"(?U)[\s&&[^\n]]++", " ")  # of all lines at once
    own = own.select("doc_id", "page", F.posexplode(F.arrays_zip(F.split("text", "\n").alias("text"), F.split(compact, "\n").alias("compact"))).alias("line_no", "line"))
    return own.select("doc_id", "page", (F.col("line_no") + 1).alias("line_no"), "line.text", F.trim("line.compact").alias("compact"))


#: Compares headings with the sections' names.
likely_section = likeliest(SECTIONS)


def section_key(label: Column) -> Column:
    """The section that a heading names; a heading in capitals may differ a little if no other section is nearly as like."""
    known = F.create_map(*(F.lit(x) for pair in SECTIONS.items() for x in pair))
    exact = F.try_element_at(known, tx.section_label(label))
    eligible = (label == F.upper(label)) & (F.size(F.split(label, " ")) <= 12) & (F.length(label) <= 120)
    return F.coalesce(exact, likely_section(F.when(exact.isNull() & eligible, tx.section_label(label))))


def told_lines(rows: DataFrame) -> DataFrame:
    """Lines with section, heading (the section that the line itself names) and next_text, in one sort of a document's lines.

    next_text: the next line that isn't blank, of the next two, on the same page, neither a label nor a numbered heading;
    for lines that begin with a label only. Unknown numbered lines end no section.
    """
    label = F.when(F.col("compact").rlike(HEADING), F.regexp_extract("compact", HEADING, 1))
    own = rows.withColumns({"heading": section_key(label), "labelled": F.col("compact").rlike(rf"(?i)^(?:{ANY_LABEL})")})
    order = Window.partitionBy("doc_id").orderBy("page", "line_no")
    ahead = [F.struct(F.lead("compact", k).over(order).alias("text"), F.lead("page", k).over(order).alias("page")) for k in (1, 2)]
    own = ln.section_fill(own, F.col("heading")).withColumn("__ahead", F.array(*ahead))
    own = own.withColumn("__next", F.when(F.col("labelled"), F.get(F.filter("__ahead", lambda x: F.coalesce(x["text"], F.lit("")) != ""), F.lit(0))))
    plain = (F.col("__next.page") == F.col("page")) & ~F.col("__next.text").rlike(rf"(?i)^(?:{ANY_LABEL})\b") & ~F.col("__next.text").rlike(HEADING)
    return own.withColumn("next_text", F.when(plain, F.col("__next.text"))).drop("__ahead", "__next")


def field_columns() -> dict[str, Column]:
    """Of told_lines: the value of each field that the line is labelled with, and the dates and days that it holds.

    A value follows its label, or is next_text. A day's number has to be there itself.
    """

    def value(field: str, labels: tuple[str, ...]) -> Column:
        pattern = rf"(?i)^(?:{'|'.join(labels)})\s*:?\s*(.*)$"
        rest = F.regexp_extract("compact", pattern, 1)
        if field == "date":
            rest = F.regexp_replace(rest, f"(?i){DATE_END}", "")
        found = F.nullif(F.regexp_extract(rest, DAY_NUMBER, 1), F.lit("")) if field == "day_no" else F.coalesce(F.nullif(rest, F.lit("")), "next_text")
        return F.when(F.col("labelled") & F.col("compact").rlike(pattern), found)

    # What is looked for first costs little and is in each text that the patterns find.
    iso = F.regexp_extract_all("text", F.lit(r"(?<!\d)(\d{4}-\d{2}-\d{2})(?!\d)"), F.lit(1))
    days = F.when(F.contains(F.col("text"), F.lit("-")), F.array_compact(F.transform(iso, dates.iso_value)))
    numbers = F.when(F.contains(F.lower("text"), F.lit("day")), F.regexp_extract_all("text", F.lit(r"(?i)\bDay\s+(\d{1,6})\b"), F.lit(1)))
    return {field: value(field, labels) for field, labels in LABELS.items()} | {"days": days, "numbers": numbers}


def document_fields(lines: DataFrame) -> DataFrame:
    """doc_id, the first labelled value of each field, the dates and days that stand without a label, and what is told.

    first_date, last_date (ISO) and first_day, last_day ('Day N') are the smallest and the largest in the text: where
    both are equal, there is only one. told_activities is null without a line of activities or remarks; n_activities
    without an activity. lines: told_lines; everything is an aggregate of one pass over them.
    """
    kept = F.col("section").isNotNull() & F.col("heading").isNull()
    own = _items(lines, kept & (F.col("section") == "daily_activities"))
    told = kept & F.col("section").isin("daily_activities", "remarks") & (F.trim("text") != "")
    own = own.select(
        "doc_id", F.struct("page", "line_no").alias("at"), F.coalesce(F.size("items"), F.lit(0)).alias("n"), F.when(told, F.col("section") == "daily_activities").alias("told"),
        F.when(told & (F.col("section") == "remarks"), F.struct("page", "line_no", "compact")).alias("remark"), *(c.alias(name) for name, c in field_columns().items()),
    )
    return own.groupBy("doc_id").agg(
        *(F.min_by(field, F.when(F.col(field).isNotNull(), F.col("at"))).alias(field) for field in LABELS),
        F.min(F.array_min("days")).alias("first_date"), F.max(F.array_max("days")).alias("last_date"),
        F.min(F.array_min("numbers")).alias("first_day"), F.max(F.array_max("numbers")).alias("last_day"),
        F.bool_or("told").alias("told_activities"), F.nullif(F.sum("n"), F.lit(0)).alias("n_activities"),
        F.array_join(F.transform(F.array_sort(F.collect_list("remark")), lambda r: r["compact"]), " ").alias("global_remarks"),
    )


def sectioned(rows: DataFrame) -> DataFrame:
    """Lines of known sections with their section; headings themselves go. Unknown numbered lines end no section."""
    return told_lines(rows).where("section is not null and heading is null").drop("heading", "labelled", "next_text")


def _items(rows: DataFrame, daily: Column) -> DataFrame:
    """rows with area_pos, area_id and items (kind, activity) of the daily lines, null or empty where there is none; all in the order of the document."""
    frame = Window.partitionBy("doc_id").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    area = F.when(daily, F.nullif(F.regexp_extract("text", AREA, 1), F.lit("")))  # a line of its own for each area, its first
    low = F.lower("text")
    left, right = F.instr(low, "activity today"), F.instr(low, "activity tomorrow")
    turn = lambda kind: F.struct(F.lit(kind).alias("kind"), left.alias("left"), right.alias("right"))
    mode = (
        F.when((left > 0) & (right > left), turn("both")).when(F.col("compact").rlike(r"(?i)^activity\s+today$"), turn("today"))
        .when(F.col("compact").rlike(r"(?i)^activity\s+tomorrow$"), turn("tomorrow")).when(F.col("compact").rlike(AREA_END), turn("none"))
    )
    own = rows.withColumns({"__area": area, "__mode": F.when(daily, mode), "__daily": daily})
    own = own.withColumns({"area_pos": F.sum(F.when(F.col("__area").isNotNull(), 1).otherwise(0)).over(frame), "__named": F.last("__area", ignorenulls=True).over(frame)})
    own = own.withColumn("__mode", F.last(F.when(F.col("__mode").isNotNull(), F.struct("area_pos", F.col("__mode").alias("turn"))), ignorenulls=True).over(frame))
    own = own.withColumn("__turn", F.when(F.col("__daily") & (F.col("__mode.area_pos") == F.col("area_pos")), F.col("__mode.turn")))
    kind, start, middle = F.col("__turn.kind"), F.col("__turn.left"), F.col("__turn.right")
    part = lambda name, cut: F.when(kind == "both", cut).when(kind == name, F.col("compact"))
    activity = lambda name, cut: tx.clean_text(tx.numbered_item(part(name, cut)))
    item = lambda name, cut: F.struct(F.lit(name).alias("kind"), F.when(kind.isin("both", name), activity(name, cut)).alias("activity"))
    both = F.array(item("today", F.substring(F.col("text"), start, middle - start)), item("tomorrow", F.substring(F.col("text"), middle, F.length("text"))))
    items = F.when(kind.isin("both", "today", "tomorrow"), F.filter(both, lambda x: x["activity"] != ""))
    named = F.coalesce(F.substring(tx.clean_text(F.col("__named")), 1, 120), F.lit("Imported PDF"))
    return own.withColumns({"area_id": named, "items": items}).drop("__area", "__mode", "__named", "__turn", "__daily")


def activities(rows: DataFrame) -> DataFrame:
    """doc_id, area_pos, area_id, kind (today or tomorrow), page, line_no, activity, from sectioned lines.

    Items stand side by side under both headings, at these headings' offsets, or one below the other under one heading each.
    """
    own = _items(rows.where("section = 'daily_activities'"), F.lit(True))
    return own.select("doc_id", "area_pos", "area_id", "page", "line_no", F.inline("items"))


def section_texts(rows: DataFrame) -> DataFrame:
    """doc_id, section and the section's text, its lines in order."""
    told = F.array_sort(F.collect_list(F.struct("page", "line_no", "text")))
    own = rows.groupBy("doc_id", "section").agg(F.array_join(F.transform(told, lambda r: r["text"]), "\n").alias("text"))
    return own.where("trim(text) <> ''")


class Imported(dict):
    """Tables by name; suggestions are looked for when they are asked for, since that writes tables of its own."""

    def __init__(self, tables: dict[str, DataFrame], suggested: Callable[[], DataFrame]):
        super().__init__(tables)
        self._suggested = suggested

    def __missing__(self, name: str) -> DataFrame:
        if name != "suggestions":
            raise KeyError(name)
        self[name] = self._suggested()
        return self[name]


def import_pages(pages: DataFrame, known: DataFrame) -> Imported:
    """records, activities, sections, warnings and suggestions. pages: doc_id, page, text; known: project_id, title, project_no.

    A record is ready if date, day and project number are there and no warning is an error; a person confirms it in any case.
    A document of blank pages gives a record without values. suggestions: the likeliest known title for documents whose
    number is unknown; never applied.
    """
    lines = told_lines(page_lines(pages))
    told = lines.where("section is not null and heading is null").drop("heading", "labelled", "next_text")
    items = activities(told)
    own = document_fields(lines).withColumnsRenamed({"date": "date_raw", "day_no": "day_label"})
    own = matching.exact_unique(own, "project_no", known.withColumnsRenamed({"project_no": "known_no"}).withColumn("known", F.struct("project_id", "title")), "known_no", "known")

    labelled = F.col("date_raw").isNotNull()
    alone, one_day = F.col("first_date") == F.col("last_date"), F.col("first_day") == F.col("last_day")
    title, master = tx.present(F.col("project_title")), tx.present(F.col("known.title"))
    own = own.withColumns({
        "date": F.when(labelled, dates.date_value(F.col("date_raw"))).when(alone, F.col("first_date")),
        "date_method": F.when(labelled, "label").when(alone, "unique"),
        "day_no": F.coalesce("day_label", F.when(one_day, F.col("first_day"))),
        "day_method": F.when(F.col("day_label").isNotNull(), "label").when(one_day, "unique"),
        "title_method": F.when(title.isNotNull(), "label").when(master.isNotNull(), "master"),
        "project_title": F.coalesce(title, master),
    })
    complete = F.col("date").isNotNull() & F.col("day_no").isNotNull() & F.col("project_no").isNotNull()
    differs = F.col("matches").isNotNull() & (tx.norm_text(F.col("project_title")) != tx.norm_text(master))
    nothing = F.coalesce(F.col("date").cast("string"), "day_no", "project_no", "project_title", "customer", "location", "equipment").isNull()
    problem = lambda code, field, error, when: F.when(when, F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"), F.lit("error" if error else "warning").alias("severity")))
    own = own.withColumn("refused", F.when(F.col("date").isNull(), dates.date_problem(F.col("date_raw"))))
    own = own.withColumn("warnings", F.array_compact(F.array(
        *(problem(code, "date", True, F.col("refused") == code) for code in ("ambiguous_numeric_date", "invalid_date", "unrecognized_date_format")),
        problem("date_inferred_without_label", "date", False, ~labelled & alone),
        problem("ambiguous_date_candidates", "date", True, ~labelled & ~alone),
        problem("day_inferred_without_label", "day_no", False, F.col("day_label").isNull() & one_day),
        problem("ambiguous_day_candidates", "day_no", True, F.col("day_label").isNull() & ~one_day),
        problem("ambiguous_exact_project_number", "project_no", True, F.col("outcome") == "ambiguous"),
        problem("project_title_master_mismatch", "project_title", False, differs),
        problem("activities_require_manual_review", "areas", False, F.col("told_activities") & F.col("n_activities").isNull()),
        *(problem(f"missing_{c}", c, True, F.col(c).isNull()) for c in ("date", "day_no", "project_no")),
        problem("no_extractable_text", "text", True, nothing & F.col("told_activities").isNull()),
    )))
    level = enums.field_confidence
    sure = lambda c: F.when(F.col(c).isNotNull(), 1.0).otherwise(0.0)
    date_level = F.when(F.col("date").isNull(), 0.0).otherwise(level(F.col("date_method")))
    records = own.select(
        "doc_id", F.col("known.project_id").alias("project_id"), "date", "date_method", "day_no", "day_method", "project_no", "project_title", "title_method", "customer", "location", "equipment",
        F.coalesce("global_remarks", F.lit("")).alias("global_remarks"),
        enums.overall_confidence(date_level, level(F.col("day_method")), sure("project_no"), level(F.col("title_method")), complete).alias("confidence"),
        F.when(complete & ~F.exists("warnings", lambda w: w["severity"] == "error"), "ready").otherwise("needs_review").alias("status"),
        F.lit(True).alias("review_required"),
    )
    unmatched = own.where("outcome = 'unknown' and title_method = 'label'").select("doc_id", "project_title")
    return Imported({
        "records": records,
        "activities": items,
        "sections": section_texts(told),
        "warnings": own.select("doc_id", F.inline("warnings")),
    }, lambda: matching.ranked(unmatched, "doc_id", "project_title", known, "project_id", "title"))
