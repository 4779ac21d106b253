"""Cumulative series: first and last values, what a period added, weighted totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_present, norm_text

PERCENTS = ("previous_plan", "previous_actual", "period_plan", "period_actual", "to_date_plan", "to_date_actual")


def item_key(item_id: Column, wbs_id: Column, id_: Column, description: Column) -> Column:
    """The first identifier that is there, else the normalised description."""
    return first_present(F.trim(item_id), F.trim(wbs_id), F.trim(id_), norm_text(description))


def history_key(row: dict[str, Column]) -> Column:
    """id:x by the first of item_id, wbs_id and id that isn't blank, else description:x; null if all are blank."""
    said = lambda kind, c: F.concat(F.lit(kind), F.nullif(norm_text(c), F.lit("")))
    return F.coalesce(*(said("id:", row[f]) for f in ("item_id", "wbs_id", "id")), said("description:", row["description"]))


def first_and_last(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """first_x and last_x of each value, by order."""
    at = F.struct(*order)
    return rows.groupBy(*keys).agg(*(f(v, at).alias(f"{name}_{v}") for v in values for name, f in (("first", F.min_by), ("last", F.max_by))))


def period_delta(last_total: Column, first_previous: Column, stated: Column) -> Column:
    """The last cumulative value less the first one before the period, else what was stated."""
    return F.coalesce(last_total - first_previous, stated)


def deviation(actual: Column, plan: Column, stated: Column) -> Column:
    return F.coalesce(actual - plan, stated)


def items(rows: DataFrame, order: list[str], keys: list[str] = (), texts: list[str] = ("description",), source_dates: bool = False) -> DataFrame:
    """One row per item key (and keys), from rows of key, texts, weight, the six PERCENTS and deviation. source_dates: with the first and last of order[0]."""
    own = first_and_last(rows, [*keys, "key"], order, [*texts, "weight", *PERCENTS, "deviation", *([order[0]] if source_dates else [])])
    out = own.select(
        *keys,
        "key",
        *(F.col(f"last_{c}").alias(c) for c in texts),
        F.col("last_weight").alias("weight"),
        F.col("first_previous_plan").alias("previous_plan"),
        F.col("first_previous_actual").alias("previous_actual"),
        period_delta(F.col("last_to_date_plan"), F.col("first_previous_plan"), F.col("last_period_plan")).alias("period_plan"),
        period_delta(F.col("last_to_date_actual"), F.col("first_previous_actual"), F.col("last_period_actual")).alias("period_actual"),
        F.col("last_to_date_plan").alias("to_date_plan"),
        F.col("last_to_date_actual").alias("to_date_actual"),
        deviation(F.col("last_to_date_actual"), F.col("last_to_date_plan"), F.col("last_deviation")).alias("deviation"),
        *(F.col(f"{end}_{order[0]}").alias(f"{end}_source_date") for end in ("first", "last") if source_dates),
    )
    return out


def weighted(value: str, weight: str = "weight") -> Column:
    """Sum of weight * value / 100 to 6 places, not divided by the sum of weights; null without a term."""
    return F.round(F.sum(F.col(weight) * F.col(value) / 100), 6)


def totals(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    own = rows.groupBy(*keys).agg(F.sum("weight").alias("weight"), *(weighted(v).alias(v) for v in PERCENTS))
    return own.withColumn("deviation", F.round(F.col("to_date_actual") - F.col("to_date_plan"), 6))


#: What a row of totals is called in data that come with one.
TOTAL_LABELS = ("total", "total overall")


def detail(rows: DataFrame, label: str) -> DataFrame:
    """rows without those of totals and those without a label."""
    word = F.lower(F.trim(label))
    return rows.where((word != "") & ~word.isin(*TOTAL_LABELS))


def with_total_row(rows: DataFrame, label: str, keys: list[str] = ()) -> DataFrame:
    """Review rows (label, weight, previous, this, plan) with to_date and variance, and a total row for each key whose weights add up to more than 0.

    A negative weight counts as 0. Rows are rounded to 4 places and totals add these up; a total's to_date and variance come from its unrounded sums.
    """
    to_4 = lambda c: F.round(c, 4)
    both, values = F.col("previous") + F.col("this"), ("previous", "this", "plan")
    shown = rows.withColumns({"weight": F.greatest("weight", F.lit(0.0)), "to_date": to_4(both), "variance": to_4(both - F.col("plan")), **{v: to_4(F.col(v)) for v in values}})
    detail_by = [*keys, label, "weight", *values, "to_date", "variance"]
    # Rows and totals are levels of one aggregation; a row that comes several times is counted, then repeated.
    sums = {v: F.sum(F.col("weight") * F.col(v) / 100).alias(f"__{v}") for v in values}
    level = shown.groupingSets([detail_by, list(keys)], *detail_by).agg(F.grouping_id().alias("__level"), F.count("*").alias("__n"), F.sum("weight").alias("__weight"), *sums.values())
    total, whole = F.col("__level") > 0, F.col("__previous") + F.col("__this")
    of = {"weight": to_4(F.col("__weight")), "to_date": to_4(whole), "variance": to_4(whole - F.col("__plan")), label: F.lit("Total"), **{v: to_4(F.col(f"__{v}")) for v in values}}
    level = level.where(~total | (F.col("__weight") > 0)).withColumn("__n", F.explode(F.array_repeat(F.lit(0), F.when(total, 1).otherwise(F.col("__n").cast("int")))))
    names = [*keys, label, "weight", "previous", "this", "to_date", "plan", "is_total", "variance"]
    return level.withColumns({**{c: F.when(total, x).otherwise(F.col(c)) for c, x in of.items()}, "is_total": total}).select(*names)


def summary(rows: DataFrame, position: str, label: str) -> DataFrame:
    """text: the last row of totals as a sentence. rows: label, to_date, plan, variance, is_total."""
    total = rows.where(F.col("is_total") | F.contains(F.lower(label), F.lit("total")))
    last = total.agg(F.max_by(F.struct("to_date", "plan", "variance"), position).alias("t"))
    return last.where("t is not null").select(F.format_string("Overall progress is %.2f%% against a plan of %.2f%% (variance %+.2f%%).", "t.to_date", "t.plan", "t.variance").alias("text"))


def s_curve(rows: DataFrame, position: str) -> DataFrame:
    """The last total row as three points of plan and actual, and the axis' top as the next 20."""
    last = rows.where("is_total").agg(F.max_by(F.struct("previous", "this", "to_date", "plan"), position).alias("t"))
    points = F.array(F.lit("Previous"), F.lit("This period"), F.lit("To date"))
    actual = F.array("t.previous", "t.this", "t.to_date")
    return last.select(points.alias("labels"), actual.alias("actual"), (F.ceil(F.greatest("t.to_date", "t.plan") / 20) * 20).alias("top"))
