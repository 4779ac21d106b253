"""JSON documents as bronze, silver and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import hidden, parse_number
from ..functions.text import clean_text, present

RECORD_TYPE = "daily_report"


def bronze(spark: SparkSession, path: str) -> DataFrame:
    """file, owner (the folder above) and doc (VARIANT) of each readable JSON document under path; unreadable ones are left out."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    file = F.col("_metadata.file_path")
    own = rows.select(file.alias("file"), F.element_at(F.split(file, "/"), -2).alias("owner"), F.try_parse_json("value").alias("doc"))
    return own.where("doc is not null")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """As bronze, for folders in which each line is a document."""
    return spark.read.text(path).select(F.try_parse_json("value").alias("doc")).where("doc is not null")


def array_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files that are JSON arrays of objects, with file and position. A file that can't be read as such counts as empty."""
    text = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    rows = F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>")
    own = text.select(F.col("_metadata.file_path").alias("file"), F.posexplode(rows).alias("position", "row"))
    return own.select("file", "position", F.try_variant_get("row", "$", f"struct<{schema}>").alias("r")).where("r is not null").select("file", "position", "r.*")


def file_list(spark: SparkSession, path: str, name: str) -> DataFrame:
    """file, name, modified and size_bytes of the files whose name matches a pattern; contents aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")
    own = rows.select(F.col("path").alias("file"), F.substring_index("path", "/", -1).alias("name"), F.col("modificationTime").alias("modified"), F.col("length").alias("size_bytes"))
    return own.where(F.col("name").rlike(f"^{name}$"))


#: JSON strings; loops without backtracking, so that long ones need no stack.
STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
#: Fields that hold images or signatures inline, and how such contents look (as JSON strings).
INLINE_FIELDS = ("img_data", "image_data", "signature_data", "photo_path")
DATA_URI = r'(?i)^"(?:\s|\\[nrtf])*+data:[^,]*;base64,'
SIGNATURE = r'^"[A-Za-z0-9+/]++={0,2}"$'


#: How deep a left out value's brackets may nest for one search to take it whole; deeper ones go by steps.
DEPTH = 12


def _left_out() -> str:
    """A pattern for what without_inline leaves out of canonical JSON text, with the comma that goes too; group 1 is what stays.

    Matches follow each other from the text's start, so that each begins at a token. Its loops are possessive: no stack grows with the text.
    """
    inner = rf'(?:{STRING}|[^"{{}}\[\]]++)*+'
    for _ in range(DEPTH - 1):
        inner = rf'(?:{STRING}|[^"{{}}\[\]]++|[{{\[]{inner}[}}\]])*+'
    rest = r'[^"\\]*+(?:\\.[^"\\]*+)*+"'
    space = r"(?:\s|\\[nrtf])"
    hidden = rf'"(?:{"|".join(INLINE_FIELDS)})":(?:{STRING}|[{{\[]{inner}[}}\]]|[^"{{}}\[\],:]++)'
    signature = rf'"sig":"(?=(?:{space}*+[A-Za-z0-9+/=]){{128}}+)(?:{space}|[A-Za-z0-9+/])++(?:={space}*+){{0,2}}+"'
    data = rf'(?:{STRING}:)?+(?i:"{space}*+data:(?:[^",\\]++|\\.)*+(?<=;base64),){rest}'
    out = f"(?:{hidden}|{signature}|{data})"
    return rf'(?:,{out})++(?=[}}\]])|{out},?+|({STRING}:?+|[^",]++|,)'


def canonical(doc: Column) -> Column:
    """JSON text with sorted keys and without white space; null if it isn't JSON (NaN and infinities aren't)."""
    return F.to_json(F.try_parse_json(doc))


def without_inline(doc: Column) -> Column:
    """Canonical JSON text without inline images and signatures, at any depth; null if it isn't JSON.

    One search over the text leaves them out; where a field's value is nested too deep for it, the text goes by steps.
    """
    text = canonical(doc)
    kept = F.regexp_replace(text, _left_out(), "$1")
    deeper = kept.rlike(f'"(?:{"|".join(INLINE_FIELDS)})":')
    return F.when(deeper, _by_steps(text)).when(kept == "", "null").otherwise(kept)


def _by_steps(text: Column) -> Column:
    """without_inline of canonical JSON text, whatever its depth.

    One pass over the text's tokens: a stack of open brackets, the key at hand, and the depth at which a value is left out.
    Members are put down with a mark before them (no JSON text holds a control character), which becomes their comma.
    """
    tokens = F.regexp_extract_all(text, F.lit(STRING + r'|[{}\[\],:]|[^"{}\[\],:]++'), F.lit(0))
    start = F.struct(F.lit("").alias("stack"), F.lit("").alias("key"), F.lit(-1).alias("left"), F.lit("").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        stack, key = acc["stack"], acc["key"]
        opens, closes, quiet = t.isin("{", "["), t.isin("}", "]"), t.isin(",", ":")
        skips = acc["left"] >= 0
        is_key = (F.right(stack, F.lit(1)) == "{") & (key == "") & ~opens & ~closes & ~quiet & ~skips
        hidden = key.isin(*(f'"{f}"' for f in INLINE_FIELDS))
        bare = F.regexp_replace(t, r"\s|\\[nrtf]", "")
        inline = t.rlike(DATA_URI) | (key == '"sig"') & (F.length(bare) >= 130) & bare.rlike(SIGNATURE)
        begins = F.concat(F.lit("\x01"), F.when(key == "", "").otherwise(F.concat(key, F.lit(":"))), t)
        below = F.substring(stack, F.lit(1), F.length(stack) - 1)
        return F.struct(
            F.when(opens, F.concat(stack, t)).when(closes, below).otherwise(stack).alias("stack"),
            F.when(is_key, t).when(quiet | skips & ~(closes & (F.length(below) == acc["left"])), key).otherwise("").alias("key"),
            F.when(~skips & opens & hidden, F.length(stack)).when(skips & closes & (F.length(below) == acc["left"]), -1).otherwise(acc["left"]).alias("left"),
            F.when(quiet | is_key | skips, acc["out"]).when(closes, F.concat(acc["out"], t)).when(hidden | ~opens & inline, acc["out"]).otherwise(F.concat(acc["out"], begins)).alias("out"),
        )

    marked = F.aggregate(tokens, start, step, lambda acc: acc["out"])
    joined = F.regexp_replace(F.regexp_replace(marked, "(^|[{\\[])\x01", "$1"), "\x01", ",")
    return F.when(marked == "", "null").otherwise(joined)


def field(doc: Column, name: str, kind: str = "string", default=None) -> Column:
    """The top value unless null or empty, else the payload's, else the default."""
    top = F.try_variant_get(doc, f"$.{name}", "string")
    inner = F.try_variant_get(doc, f"$.payload.{name}", "string")
    value = F.coalesce(F.nullif(top, F.lit("")), F.nullif(inner, F.lit("")))
    value = value if kind == "string" else value.try_cast(kind)
    return value if default is None else F.coalesce(value, F.lit(default))


def aliased(doc: Column, *names: str, default: str | None = None) -> Column:
    """The first value that is neither null nor empty under one of the names (a.b: within a), else the default."""
    found = (F.nullif(F.try_variant_get(doc, f"$.{name}", "string"), F.lit("")) for name in names)
    return F.coalesce(*found, F.lit(default))


def reports(docs: DataFrame) -> DataFrame:
    """One typed row per document of the record type."""
    d = F.col("doc")
    own = docs.where(F.try_variant_get(d, "$.record_type", "string") == RECORD_TYPE)
    return own.select(
        field(d, "username").alias("username"),
        field(d, "report_id").alias("report_id"),
        field(d, "date", "date").alias("date"),
        field(d, "project_no").alias("project_no"),
        field(d, "project_title").alias("project_title"),
        field(d, "generated_at", "timestamp").alias("generated_at"),
        field(d, "revision", "int", 0).alias("revision"),
        F.col("doc"),
    )


def texts(value: Column) -> Column:
    """The texts of a text or of lists in lists, of any depth, in order: cleaned, without blank ones. Other values hold none.

    Works on the value's JSON text: the strings that no object holds are those at brace depth 0.
    """
    json_text = F.to_json(value)
    marked = F.regexp_extract_all(json_text, F.lit(STRING + "|[{}]"), F.lit(0))

    def step(acc: Column, t: Column) -> Column:
        deeper = F.when(t == "{", 1).when(t == "}", -1).otherwise(0)
        own = F.when((acc["depth"] == 0) & (deeper == 0), F.concat(acc["own"], F.lit(","), t)).otherwise(acc["own"])
        return F.struct((acc["depth"] + deeper).alias("depth"), own.alias("own"))

    outside = F.aggregate(marked, F.struct(F.lit(0).alias("depth"), F.lit("").alias("own")), step, lambda acc: F.substring(acc["own"], 2, 2**31 - 1))
    plain = F.array_join(F.regexp_extract_all(json_text, F.lit(STRING), F.lit(0)), ",")
    every = F.from_json(F.concat(F.lit("["), F.when(F.contains(json_text, F.lit("{")), outside).otherwise(plain), F.lit("]")), "array<string>")
    return F.filter(F.transform(F.coalesce(every, F.array().cast("array<string>")), clean_text), lambda x: x != "")


def rows_of(value: Column, path: str) -> Column:
    """The objects of a list under path, as an array of VARIANT; empty where there is no list."""
    every = F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(every, lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT")))


def people_of(value: Column, path: str) -> Column:
    """name, role and hours of a list's rows that have any of them."""
    fields = ("name", "role", "hours")
    own = F.transform(rows_of(value, path), lambda m: F.struct(*(F.try_variant_get(m, f"$.{f}", "string").alias(f) for f in fields)))
    return F.filter(own, lambda m: F.coalesce(*(present(m[f]) for f in fields)).isNotNull())


#: Fields of a progress row.
PROGRESS_NUMBERS = (
    "weight_factor", "cumulative_previous_plan", "cumulative_previous_actual", "this_period_plan", "this_period_actual",
    "cumulative_to_date_plan", "cumulative_to_date_actual", "deviation",
)
PROGRESS_TEXTS = ("item_id", "wbs_id", "id", "description", "duration", "start", "finish")


def nested(doc: Column) -> dict[str, Column]:
    """A report's lists as typed columns, so that its document is parsed once: areas, indirect, progress, hides_progress."""
    text = lambda v, f: F.try_variant_get(v, f"$.{f}", "string")
    said = lambda a, f: texts(F.try_variant_get(a, f"$.{f}", "variant")).alias(f)
    area = lambda a: F.struct(
        F.coalesce(present(text(a, "id")), F.lit("Unspecified")).alias("area_id"), *(said(a, f) for f in ("activities_today", "activities_tomorrow", "constraints")),
        people_of(a, "$.manpower").alias("direct"), people_of(a, "$.indirect_manpower").alias("indirect"),
    )
    item = lambda r: F.struct(*(text(r, f).alias(f) for f in PROGRESS_TEXTS), *(parse_number(text(r, f)).alias(f) for f in PROGRESS_NUMBERS))
    return {
        "areas": F.transform(rows_of(doc, "$.payload.areas"), area),
        "indirect": people_of(doc, "$.payload.indirect_manpower"),
        "progress": F.transform(rows_of(doc, "$.payload.overall_progress"), item),
        "hides_progress": hidden(F.try_variant_get(doc, "$.payload.show_overall_progress", "string")),
    }


KEYS = ("username", "report_id", "date")


def typed(report_rows: DataFrame) -> DataFrame:
    """report_rows with the columns of nested in place of doc."""
    return report_rows.withColumns(nested(F.col("doc"))).drop("doc")


def areas(typed_rows: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row per report and area: area_pos and area."""
    return typed_rows.select(*keys, F.posexplode("areas").alias("area_pos", "area"))


def activities(area_rows: DataFrame, field_name: str = "activities_today", keys: tuple[str, ...] = KEYS) -> DataFrame:
    return area_rows.select(*keys, "area_pos", F.col("area.area_id").alias("area_id"), F.posexplode(f"area.{field_name}").alias("pos", "activity"))


def assignments(typed_rows: DataFrame, keys: tuple[str, ...] = KEYS, outer: bool = False) -> DataFrame:
    """Direct and indirect rows of all areas and of the report: category, area_pos (-1: the report), pos, name, role, hours_raw. outer: a row of nulls for a report without any."""

    def listed(people: Column, category: str, area_pos: Column) -> Column:
        return F.transform(people, lambda m, k: F.struct(F.lit(category).alias("category"), area_pos.alias("area_pos"), k.alias("pos"), m["name"].alias("name"), m["role"].alias("role"), m["hours"].alias("hours_raw")))

    by_area = F.flatten(F.transform("areas", lambda a, k: F.concat(listed(a["direct"], "direct", k), listed(a["indirect"], "indirect", k))))
    every = F.concat(listed(F.col("indirect"), "indirect", F.lit(-1)), by_area)
    return typed_rows.select(*keys, (F.explode_outer if outer else F.explode)(every).alias("m")).select(*keys, "m.*")


def progress_rows(typed_rows: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Rows of progress of the reports that show it, with their place: pos."""
    shown = typed_rows.where(~F.col("hides_progress"))
    return shown.select(*keys, F.posexplode("progress").alias("pos", "r")).select(*keys, "pos", "r.*")
