"""Alignment of two tokenizers against a plain version."""

import hashlib
from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from fieldroll.llm import alignment, queries
from fieldroll.llm.bpe import byte_characters

PATHS = queries.vocabulary(queries.BYTE_VOCABULARY), queries.vocabulary(queries.PIECE_VOCABULARY)
ODD = [None, "", " ", "  two  spaces", "\ttab\n", "plain words, and more of them.", "plain words, and more of them.", "<|endoftext|> <s> <unk>", "日本語 and ﬁ ① 🙂", "a▁b", "▁", "x" * 5000, "ab " * 3000, " " * 70, "\x00é́", "Étion de ç"]


def plain(texts):
    """Rows of alignment, link by link."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    byte_of = {c: k for k, c in enumerate(byte_characters())}
    links, rows = [], []
    for text in texts:
        wanted = (" " + (text or "")).encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        side_a = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in ids_a]
        side_b = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in ids_b for p in [b.id_to_piece(i)]]
        if not text or any(b"".join(x for _, x in s) != wanted for s in (side_a, side_b)):
            side_a = side_b = []
        ends = [np.cumsum([len(x) for _, x in s]).tolist() for s in (side_a, side_b)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in cuts]
        for k, (side, own) in enumerate(zip((side_a, side_b), ends)):
            for (i, _), e in zip(side, own):
                groups[bisect_left(cuts, e)][k].append(i)
        links.append([(x, y) for g in groups for x in g[0] for y in g[1]])
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append([len(side_a), len(side_b), len(groups), len(links[-1]), hashlib.sha256(shown.encode()).hexdigest() if groups else ""])
    count, best = defaultdict(int), defaultdict(int)
    for own in links:
        for pair in set(own):
            count[pair] += 1
            best[pair[0]] = max(best[pair[0]], count[pair])
    return sorted((k, *r[:4], sum(count[p] == best[p[0]] for p in own), sum(count[p] for p in own), r[4]) for k, (r, own) in enumerate(zip(rows, links)))


def rows_of(df):
    return sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


@pytest.mark.parametrize("most", [alignment.FREQUENT, 5])
def test_against_plain(spark, most):
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(ODD)], "doc_id long, text string, row long, pairs string").repartition(3)
    assert rows_of(alignment.alignment(docs, *PATHS, most=most)) == plain(ODD)


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    wanted = plain([r.text for r in docs])
    names = [r.doc_id for r in docs]
    assert rows_of(queries.op11_cross_tokenizer(spark, sf_dir)) == sorted((names[w[0]], *w[1:]) for w in wanted)


def test_repeated_and_none(spark):
    docs = spark.createDataFrame([(1, "one text")] * 3 + [(None, "one text")], "doc_id long, text string")
    rows = alignment.alignment(docs, *PATHS).collect()
    assert len(rows) == 4 and {r.count_sum for r in rows} == {4 * rows[0].n_links}
    assert alignment.alignment(docs.limit(0), *PATHS).count() == 0


def test_blocks():
    """Large groups, joined in blocks."""
    draw = np.random.default_rng(3)
    n = 400
    group_a, group_b = np.sort(draw.integers(0, 3, n)), np.sort(draw.integers(0, 3, n))
    ids = [pa.array(draw.integers(0, 60, n).astype(np.int32)) for _ in range(2)]
    whole = alignment.pairs_of(group_a, ids[0], group_b, ids[1], np.array([0, 0, 1]), 100)
    for block in (1, 37, 5000):
        assert alignment.pairs_of(group_a, ids[0], group_b, ids[1], np.array([0, 0, 1]), 100, block).equals(whole)
    assert sum(whole["times"].to_pylist()) == int((np.bincount(group_a, minlength=3) * np.bincount(group_b, minlength=3)).sum())
