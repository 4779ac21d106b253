"""Texts: normalisation, lines and sections, labels, dates, hashes, JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..functions import text as tx
from ..operators import lines, listings, matching, revisions
from ..registry import query, table
from ..sources.documents import canonical


@query("SELECT c_custkey FROM customer WHERE lower(trim(regexp_replace('  ' || c_mktsegment || ' ', '\\s+', ' ', 'g'))) = 'building'")
def flt02_norm_filter(spark, sf_dir):
    own = table(spark, sf_dir, "customer")
    return own.where(tx.norm_text(F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))) == tx.norm_text(F.lit(" Building  "))).select("c_custkey")


@query("SELECT doc_id, md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS key, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS n FROM documents")
def str01_norm_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.norm_text(F.col("text")).cast("binary")).alias("key"), F.length(tx.clean_text(F.col("text"))).cast("long").alias("n"))


@query("SELECT p_partkey, trim(regexp_replace(replace(upper(p_name || ' & ' || p_type), '&', ' AND '), '[^A-Z0-9]+', ' ', 'g')) AS label FROM part")
def str06_section_label(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.section_label(F.concat_ws(" & ", "p_name", "p_type")).alias("label"))


@query("SELECT page_id, left(regexp_replace(regexp_replace(trim(url), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), 80) AS part FROM pages")
def str08_file_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.file_name_part(F.col("url")).alias("part"))


@query("SELECT item_id, CASE WHEN length(text) > 60 THEN rtrim(left(text, 57)) || '...' ELSE text END AS short, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM benchmark")
def str09_bounded_escaped(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "benchmark").select("item_id", tx.bounded_text(t, 60).alias("short"), tx.escape_markup(t).alias("escaped"))


@query("SELECT item_id, CAST(len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS INTEGER) AS n FROM benchmark")
def str11_list_text(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(tx.list_text(F.col("text"))).alias("n"))


LINES_SQL = """WITH l AS (SELECT doc_id, 1 AS page, CAST(n AS INTEGER) AS line_no, x AS text FROM (SELECT doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS x, generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) AS n FROM documents))"""


def document_lines(spark, sf_dir):
    return lines.line_rows(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(LINES_SQL + "SELECT doc_id, page, line_no, md5(text) AS digest FROM l")
def src15_lines(spark, sf_dir):
    return document_lines(spark, sf_dir).select("doc_id", "page", "line_no", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(LINES_SQL + """SELECT doc_id, line_no, last_value(CASE WHEN length(text) < 20 THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM l""")
def win05_section_fill(spark, sf_dir):
    heading = F.when(F.length("text") < 20, F.col("text"))
    return lines.section_fill(document_lines(spark, sf_dir), heading).select("doc_id", "line_no", "section")


@query(LINES_SQL + "SELECT doc_id, line_no, CAST(sum(CASE WHEN length(text) < 20 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS segment FROM l")
def win06_segments(spark, sf_dir):
    return lines.segments(document_lines(spark, sf_dir), F.length("text") < 20).select("doc_id", "line_no", "segment")


@query(LINES_SQL + """SELECT doc_id, line_no, coalesce(nullif(trim(lead(text, 1) OVER w), ''), nullif(trim(lead(text, 2) OVER w), '')) AS next_text FROM l WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_no)""")
def win07_look_ahead(spark, sf_dir):
    return lines.look_ahead(document_lines(spark, sf_dir)).select("doc_id", "line_no", "next_text")


@query(LINES_SQL + "SELECT doc_id, line_no, CAST(used AS BIGINT) AS used FROM (SELECT doc_id, line_no, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY line_no) AS used FROM l) WHERE used <= 2000")
def win09_budget(spark, sf_dir):
    return lines.within_budget(document_lines(spark, sf_dir), 2000).select("doc_id", "line_no", "used")


@query("SELECT p_partkey, p_brand, CAST(floor((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) / 3) AS BIGINT) AS chunk FROM part")
def win04_chunks(spark, sf_dir):
    return lines.chunks(table(spark, sf_dir, "part"), ["p_brand"], ["p_partkey"]).select("p_partkey", "p_brand", "chunk")


@query(LINES_SQL + ", h AS (SELECT DISTINCT trim(regexp_replace(replace(upper(text), '&', ' AND '), '[^A-Z0-9]+', ' ', 'g')) AS k FROM benchmark) SELECT doc_id, line_no, k IS NOT NULL AS known FROM l LEFT JOIN h ON k = trim(regexp_replace(replace(upper(text), '&', ' AND '), '[^A-Z0-9]+', ' ', 'g'))")
def join07_known_sections(spark, sf_dir):
    labels = table(spark, sf_dir, "benchmark").select(F.col("text").alias("label"), F.lit(True).alias("section"))
    return lines.known_sections(document_lines(spark, sf_dir), labels).select("doc_id", "line_no", F.coalesce("section", F.lit(False)).alias("known"))


@query("""WITH l AS (SELECT page_id AS doc_id, CAST(n AS INTEGER) AS line_no, x FROM (SELECT page_id, unnest(string_split(html, '<')) AS x, generate_subscripts(string_split(html, '<'), 1) AS n FROM pages)),
    v AS (SELECT doc_id, line_no, regexp_extract(x, '^title>(.*)$', 1) AS t FROM l) SELECT p.page_id AS doc_id, f.title FROM pages p LEFT JOIN (SELECT doc_id, arg_min(trim(t), line_no) AS title FROM v WHERE trim(t) <> '' GROUP BY doc_id) f ON f.doc_id = p.page_id""")
def str15_label_extract(spark, sf_dir):
    worded = F.regexp_replace(F.regexp_replace("html", "\\n", " "), "<", "\n")
    own = lines.line_rows(table(spark, sf_dir, "pages").withColumn("t", F.regexp_replace(worded, "\\ntitle>", "\ntitle: ")), "page_id", "t")
    return lines.extract(own, {"title": ("title",)})


@query(LINES_SQL + "SELECT doc_id, line_no, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS item FROM l WHERE regexp_matches(text, '\\S')")
def str16_numbered(spark, sf_dir):
    line = F.concat(F.lit("  - "), (F.col("line_no") % 1000).cast("string"), F.lit(") "), "text")
    own = document_lines(spark, sf_dir).where(F.col("text").rlike(r"\S"))
    return own.select("doc_id", "line_no", F.md5(tx.numbered_item(line).cast("binary")).alias("item"))


@query("""SELECT p_partkey, trim(left(rpad(p_name, 40, ' '), 40)) AS today, trim(p_type) AS tomorrow FROM part""")
def str17_two_columns(spark, sf_dir):
    line = F.concat(F.rpad("p_name", 40, " "), "p_type")
    left, right = lines.two_columns(line, F.lit(41))
    return table(spark, sf_dir, "part").select("p_partkey", left.alias("today"), right.alias("tomorrow"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) AS b, CASE WHEN day(o_orderdate) > 12 THEN CAST(o_orderdate AS DATE) END AS c, CAST(o_orderdate AS DATE) AS d FROM orders")
def dat04_date_parse(spark, sf_dir):
    d, parse = F.col("o_orderdate"), dates.any_date
    shown = lambda f: F.date_format(d, f)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", parse(F.concat(F.lit("Date: "), shown("yyyy-MM-dd"), F.lit(" | Day: 2"))).alias("a"), parse(shown("d MMMM yyyy")).alias("b"), parse(shown("dd/MM/yyyy")).alias("c"),
        parse(F.concat(shown("MMM"), F.lit(" "), shown("d"), F.lit("th, "), shown("yyyy"))).alias("d"),
    )


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS utc, isodow(o_orderdate) - 1 AS weekday, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders")
def dat02_timestamps(spark, sf_dir):
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.utc_text(d.cast("string")).alias("utc"), F.weekday(d).cast("long").alias("weekday"), F.trunc(d, "MM").alias("month"))


@query("SELECT sha256(text) AS sha256, CAST(max(strlen(text)) AS BIGINT) AS size_bytes, count(*) AS copies FROM documents GROUP BY ALL")
def ded06_content_hash(spark, sf_dir):
    from ..sources.sinks import assets

    return assets(table(spark, sf_dir, "documents").select(F.col("text").cast("binary").alias("content")))


@query("SELECT min(doc_id) AS doc_id, md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS key FROM documents GROUP BY ALL")
def ded01_first_per_key(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.norm_text(F.col("text")).cast("binary")).alias("key"))
    return revisions.first_per_key(own, [F.col("key")], ["doc_id"])


@query("""SELECT event_id, CASE WHEN value <= 90 THEN '{"a":[1,{"b":' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',"c":null}],"k":{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '},"z":"' || event_type || '"}' END AS json FROM events""")
def jsn01_json(spark, sf_dir):
    """Read, and written again with sorted keys and without white space; what holds NaN isn't JSON."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "string")
    text = F.concat(F.lit('{ "z": "'), "event_type", F.lit('", "k": '), "props", F.lit(', "a" : [1, {"c": null, "b": '), F.when(F.col("value") > 90, "NaN").otherwise(k), F.lit("}]}"))
    return table(spark, sf_dir, "events").select("event_id", canonical(text).alias("json"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def jsn03_fenced(spark, sf_dir):
    reply = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone."))
    body = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json(body), "$.k", "bigint").alias("k"))


@query("SELECT event_id, 'k: ' || CAST(json_extract(props, '$.k') AS VARCHAR) AS described FROM events")
def map01_described(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", tx.described(F.from_json("props", "map<string,string>")).alias("described"))


@query("SELECT vec_id, CAST(n - 1 AS INTEGER) AS pos, round(CAST(x AS DOUBLE), 6) AS value FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS n FROM embeddings)")
def arr01_explode(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v")).select("vec_id", "pos", F.round(F.col("v").cast("double"), 6).alias("value"))


@query("SELECT role, conv_id, turn, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS place FROM conversations")
def agg12_activities_by_area(spark, sf_dir):
    """What belongs to a role, in order: its place there in place of a list that has to fit a row."""
    return listings.placed(table(spark, sf_dir, "conversations").select("role", "conv_id", "turn"), ["role"], ["conv_id", "turn"])


@query("""WITH k AS (SELECT lower(n_name) AS k, count(*) AS matches, min(n_nationkey) AS nk FROM nation GROUP BY ALL)
    SELECT s_suppkey, coalesce(matches, 0) AS matches, CASE WHEN matches = 1 THEN nk END AS n_nationkey, CASE WHEN matches = 1 THEN 'accepted' WHEN matches > 1 THEN 'ambiguous' ELSE 'unknown' END AS outcome
    FROM supplier JOIN nation n ON s_nationkey = n.n_nationkey LEFT JOIN k ON k = CASE WHEN s_suppkey % 5 = 0 THEN 'nowhere' ELSE lower(n.n_name) END""")
def join04_exact_unique(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    names = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.concat(F.lit(" "), F.upper("n_name")).alias("name"))
    rows = table(spark, sf_dir, "supplier").join(names, "s_nationkey").withColumn("name", F.when(F.col("s_suppkey") % 5 == 0, "nowhere").otherwise(F.col("name")))
    return matching.exact_unique(rows, "name", nation, "n_name", "n_nationkey").select("s_suppkey", "matches", "n_nationkey", "outcome")
