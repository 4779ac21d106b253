"""Text expressions. Case is folded with lower(): casefold_py is there where its few differences matter."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def clean_text(c: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def norm_text(c: Column) -> Column:
    """clean_text in lower case: the key under which texts are the same."""
    return F.lower(clean_text(c))


def present(c: Column) -> Column:
    """The text, or null where it is blank."""
    return F.nullif(clean_text(c), F.lit(""))


def first_present(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def section_label(c: Column) -> Column:
    """Upper case, & as AND, everything else but letters and digits as one space."""
    worded = F.replace(F.upper(c), F.lit("&"), F.lit(" AND "))
    return F.trim(F.regexp_replace(worded, r"[^A-Z0-9]+", " "))


def review_text(c: Column, most: int = 30_000) -> Column:
    """Without NUL, trimmed, cut at `most` characters."""
    return F.substring(F.trim(F.replace(c, F.lit("\0"), F.lit(""))), 1, most)


def bounded_text(c: Column, most: int) -> Column:
    """Trimmed and cut at `most` characters, with three dots where something is cut."""
    c = F.trim(c)
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most - 3)), F.lit("..."))).otherwise(c)


def escape_markup(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def file_name_part(c: Column, most: int = 80) -> Column:
    """Letters, digits, dot, dash and underscore; runs of others as one underscore; no edges of them."""
    kept = F.regexp_replace(F.trim(c), r"[^A-Za-z0-9._-]+", "_")
    return F.substring(F.regexp_replace(kept, r"^[._-]+|[._-]+$", ""), 1, most)


def base_name(c: Column) -> Column:
    """What follows the last slash of either kind."""
    return F.substring_index(F.replace(c, F.lit("\\"), F.lit("/")), "/", -1)


def list_text(c: Column, most: int = 500) -> Column:
    """The first `most` lines: trimmed, at 2,000 characters each, without blank ones."""
    lines = F.slice(F.split(c, r"\r\n|\r|\n"), 1, most)
    return F.filter(F.transform(lines, lambda x: review_text(x, 2000)), lambda x: x != "")


def numbered_item(c: Column) -> Column:
    """The text of a line such as '1. text' or '- 2) text'; empty if it is none."""
    return F.regexp_extract(c, r"^\s*(?:[-*•]\s*)?(\d{1,3})[.)]\s+(.+?)\s*$", 2)


def labelled_value(c: Column, *labels: str) -> Column:
    """What follows one of the labels on a line, behind a colon or two spaces; empty if none does."""
    names = "|".join(labels)
    return F.trim(F.regexp_extract(c, rf"(?i)^\s*(?:{names})(?:\s*[:=]\s*|\s{{2,}})(\S.*?)\s*$", 1))


def labelled(title: Column, text: Column, fallback: str) -> Column:
    """'TITLE: text', with a title of its own where there is none."""
    return F.concat(F.upper(F.coalesce(present(title), F.lit(fallback))), F.lit(": "), text)


def appendix_label(number: Column, title: Column, status: Column) -> Column:
    """Number, title and, in brackets, the status if there is one."""
    label = F.trim(F.concat(F.coalesce(number, F.lit("")), F.lit("    "), F.coalesce(present(title), F.lit("Appendix"))))
    return F.concat(label, F.coalesce(F.concat(F.lit("  ["), present(status), F.lit("]")), F.lit("")))


def display_name_part(c: Column, fallback: str, most: int = 100) -> Column:
    """A part of a file name that may hold spaces and brackets; runs of other characters as one dash."""
    kept = F.regexp_replace(F.coalesce(F.nullif(c, F.lit("")), F.lit(fallback)), "[^A-Za-z0-9._() -]+", "-")
    own = F.substring(F.regexp_replace(kept, "^[ ._-]+|[ ._-]+$", ""), 1, most)
    return F.coalesce(F.nullif(own, F.lit("")), F.lit(fallback))


def report_file_name(kind: Column, project: Column, start: Column, end: Column, mode: Column, revision: Column) -> Column:
    name = F.format_string("%s Progress Report - %s - %s to %s (%s) - R%s.pdf", F.initcap(kind), display_name_part(project, "Project"),
        display_name_part(start, "Start"), display_name_part(end, "End"), display_name_part(F.upper(mode), "DRAFT"), revision.cast("string"))
    return name


#: Months in letters' numbers.
ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII")


def letter_number(sequence: Column, date: Column, office: str) -> Column:
    """0001/office/VII/2026."""
    month = F.get(F.array(*map(F.lit, ROMAN)), F.month(date) - 1)
    return F.format_string("%04d/%s/%s/%d", sequence, F.lit(office), month, F.year(date))


def described(m: Column) -> Column:
    """A map as 'Label: value; ...'."""
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws(": ", e["key"], e["value"])), "; ")


def page_text(c: Column) -> Column:
    """Trimmed; line ends as one newline, no-break spaces as spaces, byte order marks and control characters gone, lines without trailing space."""
    c = F.regexp_replace(nfkc(c), r"\r\n?", "\n")
    c = F.regexp_replace(c, "[\ufeff\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "")
    c = F.regexp_replace(c, r"(?m)(?<![ \t ])[ \t ]++$", "")
    return F.regexp_replace(c, r"(?U)\A\s++|(?<!\s)\s++\z", "")


#: Texts of these characters (ASCII and geometric shapes) are the same in every normal form.
ASCII = r"\A[\x00-\x7F■-◿]*+\z"


def nfkc(c: Column) -> Column:
    """The compatibility form; only texts that aren't ASCII go through Python."""
    return F.coalesce(F.when(c.rlike(ASCII), c), _nfkc(F.when(~c.rlike(ASCII), c)))


def casefold_py(c: Column) -> Column:
    """norm_text with full case folding, for keys in which it matters; only texts that aren't ASCII go through Python."""
    return F.coalesce(F.when(c.rlike(ASCII), norm_text(c)), _casefolded(F.when(~c.rlike(ASCII), c)))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def _casefolded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else " ".join(x.split()).casefold())
