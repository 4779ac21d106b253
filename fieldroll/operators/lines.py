"""Page text as rows of lines, and what depends on their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import section_label


def line_rows(pages: DataFrame, id_: str, text: str, page: Column | None = None) -> DataFrame:
    """doc_id, page, line_no (from 1), text."""
    own = pages.select(F.col(id_).alias("doc_id"), (F.lit(1) if page is None else page).alias("page"), F.posexplode(F.split(text, r"\r\n|\n")).alias("line_no", "text"))
    return own.withColumn("line_no", F.col("line_no") + 1)


def _order(keys: tuple[str, ...] = ("doc_id",)) -> Window:
    return Window.partitionBy(*keys).orderBy("page", "line_no")


def section_fill(lines: DataFrame, heading: Column) -> DataFrame:
    """section: the last heading at or before each line of the document. heading: null for a line that is none."""
    frame = _order().rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(heading, ignorenulls=True).over(frame))


def segments(lines: DataFrame, marker: Column) -> DataFrame:
    """segment: how many marker lines there are up to each line."""
    frame = _order().rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("segment", F.sum(F.when(marker, 1).otherwise(0)).over(frame))


def look_ahead(lines: DataFrame) -> DataFrame:
    """next_text: the first of the next two lines of the page that isn't blank."""
    own = _order(("doc_id", "page"))
    following = [F.nullif(F.trim(F.lead("text", k).over(own)), F.lit("")) for k in (1, 2)]
    return lines.withColumn("next_text", F.coalesce(*following))


def within_budget(lines: DataFrame, most: int) -> DataFrame:
    """Lines up to which the characters of the document add up to `most`."""
    frame = _order().rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("used", F.sum(F.length("text")).over(frame)).where(F.col("used") <= most)


def known_sections(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """lines with the section that their normalised label names. labels: label, section; equal labels count once."""
    own = labels.select(section_label(F.col("label")).alias("__l"), "section").dropDuplicates(["__l"])
    return lines.join(own, section_label(F.col("text")) == F.col("__l"), "left").drop("__l")


def two_columns(text: Column, at: Column) -> tuple[Column, Column]:
    """A line's left and right part, cut at the right header's offset (from 1)."""
    return F.trim(F.substring(text, F.lit(1), at - 1)), F.trim(F.substring(text, at, F.length(text)))


def chunks(rows: DataFrame, keys: list[str], order: list[str], size: int = 3) -> DataFrame:
    own = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("chunk", F.floor((F.row_number().over(own) - 1) / size))


def extract(lines: DataFrame, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    """doc_id and, for each field, the first labelled value by page and line."""
    from ..functions.text import labelled_value

    at = F.struct("page", "line_no")
    found = {name: F.nullif(labelled_value(F.col("text"), *labels), F.lit("")) for name, labels in fields.items()}
    return lines.groupBy("doc_id").agg(*(F.min_by(v, F.when(v.isNotNull(), at)).alias(name) for name, v in found.items()))
