"""The period report: from typed reports to its gold tables, one project at a time or many side by side."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.numbers import parse_hours
from ..functions.text import clean_text, norm_text
from ..operators import manpower, progress
from ..operators.revisions import first_per_key
from ..sources.documents import activities, areas, assignments, progress_rows, typed
from ..sources.scratch import written

ORDER = ["revision", "generated_at", "report_id"]
PROJECT = ("project_key", "title_key")
DAY = (*PROJECT, "date")
#: What a compile calls the fields of a progress row.
RENAMED = {
    "weight": "weight_factor", "previous_plan": "cumulative_previous_plan", "previous_actual": "cumulative_previous_actual", "period_plan": "this_period_plan",
    "period_actual": "this_period_actual", "to_date_plan": "cumulative_to_date_plan", "to_date_actual": "cumulative_to_date_actual",
}
DESCRIBED = ["description", "duration", "start", "finish"]


class MixedProjects(ValueError):
    """Reports of several projects where one was expected."""


@dataclass(frozen=True)
class Compiled:
    """Gold tables by name, all keyed by PROJECT, and counters that were observed while reports were read: reports, without_date, outside, other_projects, in_period."""

    tables: dict[str, DataFrame]
    counters: dict[str, int]

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def expected_days(start: str, end: str, expected: list[str] | None) -> list[dt.date]:
    """The period's days, or those expected, once each and in order; one outside the period is an error."""
    first, last = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    if first > last:
        raise ValueError("the period ends before it starts")
    if expected is None:
        return [first + dt.timedelta(k) for k in range((last - first).days + 1)]
    days = sorted({dt.date.fromisoformat(d) for d in expected})
    if days and not first <= days[0] <= days[-1] <= last:
        raise ValueError("expected days must lie inside the period")
    return days


def chosen(reports: DataFrame, start: str, end: str, project_no: str | None, project_title: str | None, mixed: str) -> tuple[DataFrame, DataFrame, dict]:
    """All reports of the period with their keys; the one of each day as typed columns with n_reports, from a written table; counters."""
    wanted = {"project_no": project_no, "project_title": project_title}
    names = {c: norm_text(F.coalesce(c, F.lit(""))) for c in wanted}
    split = project_no is None and project_title is None and mixed == "split"
    keys = {k: names[c] if split else norm_text(F.coalesce(F.lit(wanted[c]), F.lit(""))) for k, c in zip(PROJECT, wanted)}
    ours = F.lit(True)
    for c, value in wanted.items():
        if value is not None:
            ours = ours & (names[c] == norm_text(F.lit(value)))
    dated, inside = F.col("date").isNotNull(), F.coalesce(F.col("date").between(start, end), F.lit(False))
    pair = F.when(inside & ours & (F.concat(*names.values()) != ""), F.concat_ws("\x1f", *names.values()))
    seen = Observation()
    watched = reports.observe(
        seen, F.count(F.lit(1)).alias("reports"), F.count_if(~dated).alias("without_date"), F.count_if(dated & ~inside).alias("outside"),
        F.count_if(inside & ~ours).alias("other_projects"), F.count_if(inside & ours).alias("in_period"), F.min(pair).alias("least"), F.max(pair).alias("largest"),
    )
    own = lambda df: df.where(inside & ours).withColumns(keys)
    rest = [c for c in reports.columns if c != "date"]
    best = own(watched).groupBy(*DAY).agg(F.max_by(F.struct(*rest), F.struct(*ORDER)).alias("__best"), F.count("*").alias("n_reports"))
    selected = written(typed(best.select(*DAY, "n_reports", *(F.col(f"__best.`{c}`").alias(c) for c in rest))), "selected")
    counters = dict(seen.get)
    least, largest = counters.pop("least"), counters.pop("largest")
    every = own(reports)
    if project_no is None and project_title is None and not split:
        if least != largest:
            raise MixedProjects("reports of several projects: name one, or split them")
        project = dict(zip(PROJECT, map(F.lit, (least or "\x1f").split("\x1f"))))  # the only one, which undecided reports join
        selected, every = selected.withColumns(project), every.withColumns(project)
    return every, selected, counters


def told(area_rows: DataFrame, field_name: str) -> DataFrame:
    """A list of all areas: one of each day, area and text."""
    every = activities(area_rows, field_name, DAY)
    return first_per_key(every, [*map(F.col, DAY), norm_text(F.col("area_id")), norm_text(F.col("activity"))], ["date", "area_pos", "pos"])


def compile_period(
    reports: DataFrame, start: str, end: str, project_no: str | None = None, project_title: str | None = None, expected_dates: list[str] | None = None, mixed: str = "split"
) -> Compiled:
    """Gold tables of one period.

    A name of a project selects its reports. Without one, mixed="refuse" takes reports of one project only
    (those that name none join it) and mixed="split" compiles each project for itself. Reports are read once,
    for the table that is written as `selected`; the others are made from it, but for `superseded`.
    """
    days = expected_days(start, end, expected_dates)
    own, selected, counters = chosen(reports, start, end, project_no, project_title, mixed)
    best = selected.select(*DAY, *(F.col(c).alias(f"__{c}") for c in ORDER))
    at = F.struct(*(F.col(f"__{c}").alias(c) for c in ORDER))
    per_area = areas(selected, DAY)
    last = selected.groupBy(*PROJECT).agg(F.max_by(F.struct("date", "areas"), "date").alias("r")).select(*PROJECT, "r.*")
    rows = assignments(selected, DAY, outer=True).withColumns({"hours": parse_hours(F.col("hours_raw")), "row_pos": F.struct("area_pos", "pos")})
    key = manpower.person_key(F.col("name"), F.col("category"), F.concat_ws(":", "area_pos", "pos"))
    rows = rows.withColumn("person_key", F.when(F.col("category").isNotNull(), key))
    people = manpower.combined(rows, list(DAY))
    daily = manpower.daily(people, list(DAY))
    items = progress_items(selected)
    spine, reported = spine_of(selected, days), selected.select(*DAY)
    return Compiled({
        "selected": selected,
        "superseded": own.join(best, [*DAY]).where(F.struct(*ORDER) < at).select(*own.columns),
        "coverage": coverage_of(selected, days),
        "missing": spine.join(reported, [*DAY], "left_anti"),
        "extra": reported.where(~F.col("date").isin(days)) if days else reported,
        "activities": told(per_area, "activities_today"),
        "tomorrow": told(areas(last, DAY), "activities_tomorrow"),
        "constraints": told(per_area, "constraints"),
        "manpower_daily": daily,
        "manpower_totals": manpower.totals(daily, list(PROJECT)),
        "roles": manpower.roles(people.where("person_key is not null"), ["date"], list(PROJECT)),
        "progress": items,
        "progress_totals": progress_totals(items),
    }, counters)


def spine_of(selected: DataFrame, days: list[dt.date]) -> DataFrame:
    """Every expected day of every project."""
    every: Column = F.array(*map(F.lit, days)).cast("array<date>")
    return selected.select(*PROJECT).distinct().select(*PROJECT, F.explode(every).alias("date"))


def coverage_of(selected: DataFrame, days: list[dt.date]) -> DataFrame:
    """For each project: covered, missing and unexpected days, superseded reports, days with several, the last day, whether it is partial."""
    met = F.count_if(F.col("date").isin(days)) if days else F.lit(0)
    return selected.groupBy(*PROJECT).agg(
        F.count("*").alias("covered_days"), (F.lit(len(days)) - met).cast("long").alias("missing_days"), (F.count("*") - met).cast("long").alias("extra_days"),
        F.sum(F.col("n_reports") - 1).alias("superseded_count"), F.count_if(F.col("n_reports") > 1).alias("duplicate_days"),
        F.max("date").alias("last_report_date"), (met < len(days)).alias("is_partial"),
    )


def progress_items(selected: DataFrame) -> DataFrame:
    """One row per project and item: what the period added is the last cumulative value less the first one before it."""
    rows = progress_rows(selected, DAY)
    rows = rows.withColumn("key", progress.history_key({f: F.col(f) for f in ("item_id", "wbs_id", "id", "description")})).where("key is not null")
    rows = rows.withColumns({**{new: F.col(old) for new, old in RENAMED.items()}, **{c: clean_text(F.coalesce(c, F.lit(""))) for c in DESCRIBED}})
    return progress.items(rows, ["date", "pos"], list(PROJECT), DESCRIBED, source_dates=True)


def progress_totals(items: DataFrame) -> DataFrame:
    return progress.totals(items, list(PROJECT)).withColumn("weight", F.round("weight", 6))
