"""Records from pages: an order stands for a document whose page is written from its columns, a customer for a known project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import text as tx
from ..plans import page_import
from ..registry import query, table


def pages(spark, sf_dir) -> DataFrame:
    """Dates are labelled and ISO, labelled in figures, without a label, or missing, by o_orderkey % 4."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    shown = lambda f: F.date_format(d, f)
    date = F.when(k % 4 == 0, F.concat(F.lit("Report Date : "), shown("yyyy-MM-dd"))).when(k % 4 == 1, F.concat(F.lit("Date   "), shown("dd/MM/yyyy"))).when(k % 4 == 2, F.concat(F.lit("issued "), shown("yyyy-MM-dd"))).otherwise(F.lit("undated"))
    heads = F.concat(F.rpad(F.lit("Activity Today"), 40, " "), F.lit("Activity Tomorrow"))
    item = F.concat(F.rpad(F.concat(F.lit("1. "), "o_orderpriority"), 40, " "), F.lit("1. Order "), k.cast("string"))
    text = F.concat_ws("\n", F.concat(F.lit("Project No.   "), F.col("o_custkey").cast("string")), date, F.concat(F.lit("Working Day   Day "), (k % 500).cast("string")),
        F.lit("4. DAILY ACTIVITIES & MANPOWER BY AREA"), F.concat(F.lit("■ Unit "), "o_orderstatus"), heads, item, F.lit("6. REMARKS"), F.concat(F.lit("Seen  by "), F.lower("o_orderstatus")))
    # Orders are spread before their pages are written: a small file is a single task's.
    return table(spark, sf_dir, "orders").repartition("o_orderkey").select(k.alias("doc_id"), F.lit(1).alias("page"), text.alias("text"))


def known(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("title"), F.col("c_custkey").cast("string").alias("project_no"))


DATED = """WITH r AS (SELECT o_orderkey AS doc_id, o_orderkey % 4 AS m, c_custkey AS project_id, o_custkey, c_name AS project_title, o_orderstatus, o_orderpriority, CAST(o_orderkey % 500 AS VARCHAR) AS day_no,
    CASE WHEN o_orderkey % 4 IN (0, 2) OR (o_orderkey % 4 = 1 AND day(o_orderdate) > 12) THEN CAST(o_orderdate AS DATE) END AS date FROM orders LEFT JOIN customer ON c_custkey = o_custkey)"""


@query(DATED + """SELECT doc_id, project_id, date, CASE WHEN m = 2 THEN 'unique' WHEN m < 2 THEN 'label' END AS date_method, day_no, CAST(o_custkey AS VARCHAR) AS project_no, project_title, 'Seen by ' || lower(o_orderstatus) AS global_remarks,
    CASE WHEN date IS NULL THEN 0.69 ELSE round((2 * CASE WHEN m = 2 THEN 0.8 ELSE 1 END + 2 + 2 + CASE WHEN project_title IS NULL THEN 0 ELSE 1 END) / 7.0, 4) END AS confidence, CASE WHEN date IS NULL THEN 'needs_review' ELSE 'ready' END AS status FROM r""")
def src08_page_records(spark, sf_dir):
    own = page_import.import_pages(pages(spark, sf_dir), known(spark, sf_dir))["records"]
    return own.select("doc_id", "project_id", "date", "date_method", "day_no", "project_no", "project_title", "global_remarks", "confidence", "status")


@query(DATED + """SELECT doc_id, 'Unit ' || o_orderstatus AS area_id, kind, CASE kind WHEN 'today' THEN trim(o_orderpriority) ELSE 'Order ' || doc_id END AS activity FROM r, (VALUES ('today'), ('tomorrow')) v(kind)""")
def win06_area_activities(spark, sf_dir):
    told = page_import.sectioned(page_import.page_lines(pages(spark, sf_dir)))
    return page_import.activities(told).select("doc_id", "area_id", "kind", "activity")


@query(DATED + """SELECT doc_id, code FROM r, (VALUES ('ambiguous_numeric_date', 1), ('date_inferred_without_label', 2), ('missing_date', 1), ('missing_date', 3)) v(code, m2) WHERE m = m2 AND (date IS NULL OR m = 2)""")
def cnf02_import_warnings(spark, sf_dir):
    return page_import.import_pages(pages(spark, sf_dir), known(spark, sf_dir))["warnings"].select("doc_id", "code")


@query("""WITH d AS (SELECT page_id, CAST(x AS DATE) AS d FROM (SELECT page_id, unnest(regexp_extract_all(html, '\\b\\d{4}-\\d{2}-\\d{2}\\b')) AS x FROM pages) WHERE TRY_CAST(x AS DATE) IS NOT NULL AND CAST(left(x, 4) AS INTEGER) BETWEEN 1900 AND 2200)
    SELECT p.page_id, CASE WHEN count(DISTINCT d) = 1 THEN min(d) END AS date, CASE count(DISTINCT d) WHEN 0 THEN 'none' WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS found FROM pages p LEFT JOIN d ON d.page_id = p.page_id GROUP BY p.page_id""")
def dat05_only_date(spark, sf_dir):
    days = F.array_compact(F.transform(F.regexp_extract_all("html", F.lit(r"\b(\d{4}-\d{2}-\d{2})\b"), F.lit(1)), dates.date_value))
    first, last = F.array_min(days), F.array_max(days)
    found = F.when(first.isNull(), "none").when(first == last, "unique").otherwise("ambiguous")
    return table(spark, sf_dir, "pages").select("page_id", F.when(first == last, first).alias("date"), found.alias("found"))


@query("""WITH d AS (SELECT doc_id, regexp_extract_all(text, '[Dd]ay\\s+(\\d{1,6})\\b', 1) AS x FROM documents) SELECT doc_id, CASE WHEN len(list_distinct(x)) = 1 THEN x[1] END AS day_no, coalesce(len(list_distinct(x)), 0) > 1 AS ambiguous FROM d""")
def dat06_only_day(spark, sf_dir):
    x = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[Dd]ay\s+(\d{1,6})\b"), F.lit(1)))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.size(x) == 1, F.get(x, F.lit(0))).alias("day_no"), (F.coalesce(F.size(x), F.lit(0)) > 1).alias("ambiguous"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CASE WHEN day(o_orderdate) <= 12 THEN 'ambiguous_numeric_date' END WHEN 1 THEN 'invalid_date' ELSE 'unrecognized_date_format' END AS problem FROM orders""")
def dat04_problems(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.when(k % 3 == 0, F.date_format(d, " d/M/yyyy.")).when(k % 3 == 1, F.date_format(d, "yyyy-13-dd")).otherwise(F.date_format(d, "yyyy MMM"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.date_problem(text).alias("problem"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'remarks' WHEN p_partkey % 3 = 1 THEN 'area_of_concern' END AS section FROM part""")
def join06_section_headings(spark, sf_dir):
    k = F.col("p_partkey")
    label = F.when(k % 3 == 0, " Remarks: ").when(k % 3 == 1, "AREA OF CONCERN AND SUGGESTED CORRECTIVE ACTIONS").otherwise(F.concat(F.lit("Part "), "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", page_import.section_key(label).alias("section"))


@query("SELECT doc_id, md5(replace(lower(trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g'))), 'ß', 'ss')) AS key FROM documents")
def str07_identifier(spark, sf_dir):
    """All documents; of theirs, only ß has a folded form of its own, and none a compatibility form."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.casefold_py(tx.nfkc(F.col("text"))).cast("binary")).alias("key"))
