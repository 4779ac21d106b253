"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast hash table from frequent pre-tokens to their numbers of tokens, of at most
FREQUENT entries. It is counted over all texts: each task counts its runs of non-space, splits the
distinct ones into pre-tokens and sends only its heaviest ones on, so no stream of pre-tokens is ever
shuffled. Tier two is a bounded cache in each worker, filled by the vocabulary's own model for
pre-tokens that miss. What is in either tier changes the speed alone, never a count.

Defined results: a null text counts as empty (0 bytes, 0 tokens); an empty table gives an empty
result; repeated rows give repeated results; other columns of the input are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_characters
from .common import Memo, map_batches

#: Entries of the broadcast table: some 2 MB.
FREQUENT = 32_768

#: Fixed value: how the word vocabulary splits a lower-cased text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordCounter:
    """Numbers of tokens under one word-end vocabulary file."""

    def __init__(self, path: str, frequent: dict[str, int] | None = None):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        special = [t.content for t in library.get_added_tokens_decoder().values()]
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.model = library.model
        self.letters = byte_characters()
        self.pretokens = regex.compile(SPLIT).findall
        self.spaces = regex.compile(r"\s+")
        self.odd_space = re.compile("[\x1c-\x1f]").search
        self.frequent = frequent or {}
        self.missed = Memo(self.by_model)
        self.runs = Memo(self.of_run)

    def by_model(self, pretoken: str) -> int:
        return len(self.model.tokenize("".join(self.letters[b] for b in pretoken.encode())))

    def of_run(self, run: str) -> int:
        n = 0
        for pretoken in (run,) if run.isalpha() else self.pretokens(run):
            known = self.frequent.get(pretoken)
            n += self.missed[pretoken] if known is None else known
        return n

    def split(self, text: str) -> list[str]:
        """The runs of non-space of a text without special tokens, normalised as the vocabulary does."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower() alone gives a final sigma
        text = text.lower()
        return self.spaces.split(text) if self.odd_space(text) else text.split()

    def count(self, text: str) -> int:
        found = self.at_special.findall(text) if self.at_special and "<|" in text else []
        parts = self.at_special.split(text) if found else [text]
        return len(found) + sum(sum(map(self.runs.__getitem__, self.split(p))) for p in parts)


@lru_cache(maxsize=4)
def plain_counter(path: str) -> WordCounter:
    return WordCounter(path)


def frequent_pretokens(docs: DataFrame, path: str, text_col: str = "text", most: int = FREQUENT) -> DataFrame:
    """pretoken, n: frequent pre-tokens over all texts; each task sends on its `most` heaviest at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, seen = plain_counter(path), Counter()
        found: Counter = Counter()

        def settle() -> None:
            for run_, n in seen.items():
                for pretoken in (run_,) if run_.isalpha() else c.pretokens(run_):
                    found[pretoken] += n
            seen.clear()
            if len(found) > 8 * most:
                for pretoken, n in found.most_common()[4 * most :]:
                    del found[pretoken]

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(c.split(text or ""))
                if len(seen) > 4 * most:
                    settle()
        settle()
        top = [x for x in found.most_common(most) if x[1] > 1 and len(x[0]) <= 64]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["pretoken", "n"])

    parts = docs.select(docs[text_col].alias("t")).mapInArrow(run, "pretoken string, n bigint")
    return parts.groupBy("pretoken").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pretoken").limit(most)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    spark = docs.sparkSession
    model = plain_counter(path)
    table = {r["pretoken"]: model.by_model(r["pretoken"]) for r in frequent_pretokens(docs, path, text_col).collect()}
    shared = spark.sparkContext.broadcast(table)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = worker_counter(path, shared)
        counts = [c.count(t or "") for t in batch.column(2).to_pylist()]
        arrays = [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts])]
        return pa.RecordBatch.from_arrays(arrays, ["id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(docs[id_col].alias("id"), F.coalesce(F.octet_length(docs[text_col]), F.lit(0)).cast("long").alias("n_bytes"), docs[text_col].alias("t"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    return map_batches(rows, run, schema).withColumnRenamed("id", id_col)


_of_table: list = [None, None]


def worker_counter(path: str, shared) -> WordCounter:
    """The worker's counter for this broadcast table, made once."""
    table = shared.value
    if _of_table[0] is not table:
        _of_table[:] = [table, WordCounter(path, table)]
    return _of_table[1]
