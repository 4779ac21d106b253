"""The pipeline against a plain version of its stages."""

import re

import corpus_pipeline
from fieldroll.llm import bpe, queries

from .test_near_dedup import shingles
from .test_operators import brute_components


def test_run(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    left = {k: t for k, t in docs.items() if t and re.search(r"[^\W\d_]", t)}
    ids = sorted(left)
    own = {i: shingles(left[i]) for i in ids}
    label = brute_components(ids, lambda a, b: 10 * len(own[a] & own[b]) >= 8 * len(own[a] | own[b]))
    kept = {i for i in ids if label[i] == i}
    clean = {k for k in kept if not any(x in left[k] for x in items)}
    assert set(rows) == clean
    coder = bpe.coder(queries.vocabulary(queries.BYTE_VOCABULARY))
    texts = {k: coder.decode(list(r.ids)) for k, r in rows.items()}
    assert all(t == left[k] or "[secret]" in t for k, t in texts.items())
    assert not any(re.search(r"AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}", t) for t in texts.values())


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "benchmark_decontamination", "secret_scans", "bpe_tokens"]


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls, empty texts, repeated rows, extra columns and empty tables, stage by stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, blob string, spans int"
    said = "the words of this document go on for a while and then they stop"
    rows = [(1, said, None, None, None, "r", "b", 1), (1, said, None, None, None, "r", "b", 1), (2, None, "en", "s", 0, None, None, None), (3, "", "en", "s", 0, "", "", 0), (None, "no id but token = abcdefgh12", "en", "s", 9, "", "", 0), (5, "½", "en", "s", 1, "", "", 0), (6, "die Worte " * 9, "de", "s", 1, "", "", 0)]
    docs = spark.createDataFrame(rows, schema)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        out = stage(spark, docs, sf_dir)
        assert name == "bpe_tokens" or out.schema.names == docs.schema.names
        kept[name] = out.collect()
    assert sorted(str(r.doc_id) for r in kept["language_id"]) == ["1", "1", "6", "None"]
    assert {r.lang for r in kept["language_id"] if r.doc_id == 6} == {"de"}
    assert sum(r.doc_id == 1 for r in kept["near_dedup"]) == 1
    assert len(kept["benchmark_decontamination"]) == len(kept["bpe_tokens"]) == len(kept["secret_scans"]) == len(rows)
    masked = next(r for r in kept["secret_scans"] if r.doc_id is None)
    assert masked.text == "no id but [secret]" and masked.n_chars == len(masked.text) and (masked.row, masked.spans) == ("", 0)
    assert next(r for r in kept["secret_scans"] if r.doc_id == 2).text is None
    assert {r.lang for r in kept["bpe_tokens"]} == {None, "en", "de"}
