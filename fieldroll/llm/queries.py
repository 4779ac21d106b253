"""One query for each corpus operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, decontamination, embeddings, html_text, langid, mixing, prefix_tries, secrets, simhash, token_counts, toxicity, warc
from .common import id_crc, new_path, ship

WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from the archives."""
    archives = warc.write_archives(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    rows = warc.read_archives(spark, archives, keep_payload=False)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "problem")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), where=id_crc("doc_id") % 5 != 0)
    held_out = F.coalesce(id_crc("doc_id") % 5 == 0, F.lit(False))
    return toxicity.score(docs, model, keep={"doc_id": F.col("doc_id"), "held_out": held_out})


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, from a new ledger."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = secrets.scanned(docs, secrets.Ledger(spark, new_path(spark, "ledger")))
    counts = [secrets.number(F.col("spans"), r).alias(f"n_{r.kind}") for r in secrets.RULES]
    spans = secrets.joined(F.col("spans"))
    return rows.select("doc_id", *counts, F.sha2(spans.cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars."""
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary(BYTE_VOCABULARY))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, start, end, edits: a row for each text and benchmark item found in it."""
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(id_crc("doc_id") % 4 != 2))
    held_out = F.coalesce(id_crc("doc_id") % 4 == 2, F.lit(False))
    return langid.identify(docs, model, keep={"doc_id": F.col("doc_id"), "held_out": held_out}).drop("languages")


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    return alignment.alignment(table(spark, sf_dir, "documents"), vocabulary(BYTE_VOCABULARY), vocabulary(PIECE_VOCABULARY))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    return prefix_tries.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    mix = mixing.mixed(table(spark, sf_dir, "documents")).documents()
    return mix.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "weight")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_warc, op2_toxicity, op3_token_counts, op4_secret_scans, op5_simhash, op6_html_text, op7_bpe, op8_decontamination, op9_embeddings, op10_language_id, op11_cross_tokenizer, op12_prefix_trie, op13_source_mix)
}

_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _spans_sql(kind: str, order: int, matches: str, gaps: str, kept: str) -> str:
    length = "lambda x: length(x)"
    before = f"CAST(list_sum(list_transform({gaps}[1:i], {length})) + coalesce(list_sum(list_transform({matches}[1:i-1], {length})), 0) AS BIGINT)"
    return f"""list_transform(list_filter(range(1, len({matches}) + 1), lambda i: length({kept}[i]) >= {dict(assign=8, access=16, hex=32)[kind]}),
        lambda i: {{'s': {before}, 'k': {order}, 'e': {before} + length({matches}[i])}})"""


ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest FROM pages),
        r AS (SELECT digest, max(page_id) AS response FROM p WHERE strlen(html) >= 1000 GROUP BY digest)
        SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest,
               CASE WHEN response IS NULL OR response = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN response <> page_id THEN response END AS refers_to, url AS target_uri, CAST(NULL AS VARCHAR) AS problem
        FROM p LEFT JOIN r USING (digest)""",
    "op4_secret_scans": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        m AS (SELECT doc_id, regexp_extract_all(t, '{_ASSIGN}', 0) AS a, regexp_extract_all(t, '{_ASSIGN}', 2) AS a2, string_split_regex(t, '{_ASSIGN}') AS ag,
                     regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0) AS b, string_split_regex(t, 'AKIA[A-Z0-9]+') AS bg,
                     regexp_extract_all(t, '[0-9a-f]+', 0) AS c, string_split_regex(t, '[0-9a-f]+') AS cg FROM d),
        s AS (SELECT doc_id, {_spans_sql("assign", 0, "a", "ag", "a2")} AS x, {_spans_sql("access", 1, "b", "bg", "b")} AS y, {_spans_sql("hex", 2, "c", "cg", "c")} AS z FROM m),
        j AS (SELECT doc_id, len(x) AS n_assign, len(y) AS n_access, len(z) AS n_hex,
                     coalesce(array_to_string(list_transform(list_sort(list_concat(list_concat(x, y), z)), lambda q: (['assign', 'access', 'hex'])[q.k + 1] || ':' || q.s || ':' || q.e), ','), '') AS spans FROM s)
        SELECT doc_id, CAST(n_assign AS BIGINT) AS n_assign, CAST(n_access AS BIGINT) AS n_access, CAST(n_hex AS BIGINT) AS n_hex, sha256(spans) AS base_sha256, spans FROM j""",
    "op12_prefix_trie": """
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS unit, length(coalesce(text, '')) AS n
                   FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, list({'u': unit, 'n': n} ORDER BY turn NULLS FIRST, role, unit) AS own,
                     xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
                         lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda p, q: xor(p >> 1, (p & 1) * 3988292384))), 4294967295) % 6 AS h FROM t GROUP BY conv_id),
        r AS (SELECT c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) AS path FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 100),
        p AS (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS depth FROM r),
        g AS (SELECT path[1:depth] AS key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(path[depth].n), 0) AS n,
                     sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(path) = depth), '')) AS ends_sha256 FROM p GROUP BY 1, 2),
        k AS (SELECT key[1:depth - 1] AS key, depth - 1 AS depth, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY 1, 2),
        f AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN k USING (key, depth)),
        a AS (SELECT *, unnest(range(0, depth + 1)) AS above FROM f),
        s AS (SELECT key[1:above] AS key, above AS depth, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * n) AS saved_tokens FROM a GROUP BY 1, 2)
        SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
        FROM f JOIN s USING (key, depth) LEFT JOIN g u ON u.depth = f.depth - 1 AND u.key = f.key[1:f.depth - 1]""",
    "op13_source_mix": r"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                          CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS place FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
        w AS (SELECT *, CAST(([5, 2, 1])[(rank - 1) % 3 + 1] AS BIGINT) AS weight, 2 * source_size AS most FROM s),
        f AS (SELECT *, most / CAST(weight AS DOUBLE) AS fill,
                     CAST(sum(source_size) OVER () * 3 - 2 * (coalesce(sum(most) OVER (ORDER BY most / CAST(weight AS DOUBLE), rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS BIGINT) AS budget_left,
                     CAST(2 * sum(weight) OVER (ORDER BY most / CAST(weight AS DOUBLE), rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest FROM w),
        l AS (SELECT fill AS l_fill, rank AS l_rank, budget_left AS l_left, rest AS l_rest FROM f WHERE CAST(most AS HUGEINT) * rest > CAST(budget_left AS HUGEINT) * weight ORDER BY fill, rank LIMIT 1),
        t AS (SELECT source, source_size, rank, weight,
                     CASE WHEN (fill, rank) >= (l_fill, l_rank) THEN CAST(weight * l_left AS DOUBLE) / CAST(l_rest AS DOUBLE) ELSE CAST(most AS DOUBLE) END AS target,
                     CASE WHEN (fill, rank) >= (l_fill, l_rank) THEN weight * l_left // l_rest ELSE most END AS due
              FROM f LEFT JOIN l ON true),
        q AS (SELECT row_number() OVER () AS id, d.doc_id, d.source, d.size, t.* EXCLUDE (source),
                     coalesce(sum(size) OVER (PARTITION BY t.rank ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        p AS (SELECT id, rank, weight, due, pass, first + pass * source_size AS start, first + pass * source_size + size AS last FROM q, (SELECT unnest([0, 1]) AS pass) WHERE size > 0),
        o AS (SELECT *, CASE WHEN start < due AND due < last THEN due ELSE last END AS stop FROM p),
        r AS (SELECT id, stop - start AS words, coalesce(sum(stop - start) OVER (ORDER BY CAST(stop AS DOUBLE) / weight, rank, pass, start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o),
        b AS (SELECT sum(size) * 3 // 2 AS budget FROM d),
        g AS (SELECT id, sum(greatest(0, least(words, budget - before))) AS taken FROM r, b GROUP BY id)
        SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, source, weight FROM q LEFT JOIN g USING (id)""",
}
