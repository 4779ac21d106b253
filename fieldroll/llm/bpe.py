"""BPE encoding and decoding with a contiguous rank array.

A pre-token is a list of part ids with, beside it, the list of the ranks of adjacent parts. The
smallest rank is looked up again and again, its boundary is deleted and the ranks on either side are
refreshed. For the short words of real text both lists fit in a cache line or two, and beat a heap;
pre-tokens of over LONG bytes take a heap with linked parts, which gives the same ids in n log n.

Texts stay where they are: encoding is one map over the rows, without a shuffle.

Defined results: a null text counts as empty (0 ids, the digests of nothing); an empty table gives
an empty result; repeated rows give repeated results; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache
from itertools import accumulate, chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Memo, map_batches

#: Pre-tokens above this many bytes take the heap.
LONG = 400
NEVER = 1 << 60

#: Fixed value: how byte-level vocabularies split a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = iter(range(256, 512))
    return [chr(b if b in plain else next(moved)) for b in range(256)]


class ByteBpe:
    """Encoder and decoder for one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_characters()
        to_byte = {c: b for b, c in enumerate(letters)}
        self.of_byte = [vocab[c] for c in letters]
        self.after: list[dict[int, int]] = [{} for _ in range(max(vocab.values()) + 1)]  # by left id: rank by right id
        self.merged: list[int] = []
        for pair in merges:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.after[vocab[left]].setdefault(vocab[right], len(self.merged))
            self.merged.append(vocab[left + right])
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        tokens = {**vocab, **special}
        self.bytes_of = [b""] * (max(tokens.values()) + 1)
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        for token, i in tokens.items():
            known = token not in special and all(c in to_byte for c in token)
            self.bytes_of[i] = bytes(to_byte[c] for c in token) if known else token.encode()
        self.special = special
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.words = regex.compile(SPLIT).findall
        self.wide_gap = re.compile(r"\s\s").search
        self.memo = Memo(self.word)
        self.run_memo = Memo(self.run)

    def word(self, word: str) -> tuple[int, ...]:
        """The ids of one pre-token."""
        ids = list(map(self.of_byte.__getitem__, word.encode()))
        return tuple(self.by_array(ids) if len(ids) <= LONG else self.by_heap(ids))

    def run(self, run: str) -> tuple[int, ...]:
        """The ids of one space and the run up to the next one."""
        if run.isalpha():
            return self.word(" " + run)
        return tuple(chain.from_iterable(map(self.memo.__getitem__, self.words(" " + run))))

    def by_array(self, ids: list[int]) -> list[int]:
        after, merged = self.after, self.merged
        ranks = [after[a].get(b, NEVER) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            i = ranks.index(least)
            ids[i] = new = merged[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = after[ids[i - 1]].get(new, NEVER)
            if i < len(ranks):
                ranks[i] = after[new].get(ids[i + 1], NEVER)
        return ids

    def by_heap(self, ids: list[int]) -> list[int]:
        after, n = self.after, len(ids)
        left_of, right_of = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := after[ids[i]].get(ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = right_of[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j] = self.merged[r], -1
            right_of[i] = right_of[j]
            if right_of[j] >= 0:
                left_of[right_of[j]] = i
            for a, b in ((left_of[i], i), (i, right_of[i])):
                if a >= 0 and b >= 0 and (new := after[ids[a]].get(ids[b])) is not None:
                    heapq.heappush(heap, (new, a, ids[a], ids[b]))
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> list[int]:
        if self.at_special is None or not self.at_special.search(text):
            if self.wide_gap(text):
                return list(chain.from_iterable(map(self.memo.__getitem__, self.words(text))))
            # Where no two white spaces meet, each single space begins a pre-token.
            first, *runs = text.split(" ")
            out = list(chain.from_iterable(map(self.memo.__getitem__, self.words(first))))
            out.extend(chain.from_iterable(map(self.run_memo.__getitem__, runs)))
            return out
        out: list[int] = []
        for part in self.at_special.split(text):
            out += [self.special[part]] if part in self.special else self.encode(part) if part else []
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def coder(path: str) -> ByteBpe:
    """One per worker and file."""
    return ByteBpe(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids: the token ids of every whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = coder(path)
        ids = pa.array([c.encode(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column(0), ids], ["id", "ids"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("t"))
    return map_batches(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text: what the ids stand for; a null list gives an empty text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = coder(path)
        texts = pa.array([c.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), texts], ["id", "text"])

    rows = tokens.select(tokens[id_col].alias("id"), tokens[ids_col].alias("x"))
    return map_batches(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids, then the columns to keep, from encoding and decoding in the same task."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = coder(path)
        counts, id_digests, text_digests, every = [], [], [], []
        for text in batch.column(1).to_pylist():
            ids = c.encode(text or "")
            counts.append(len(ids))
            if with_ids:
                every.append(pa.array(ids, pa.int32()))
            id_digests.append(hashlib.sha256(",".join(map(c.text_of.__getitem__, ids)).encode()).hexdigest())
            text_digests.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
        arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_digests), pa.array(text_digests)]
        names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            flat = pa.concat_arrays(every) if every else pa.array([], pa.int32())
            arrays.append(pa.ListArray.from_arrays(pa.array([0, *accumulate(counts)], pa.int32()), flat))
            names.append("ids")
        return pa.RecordBatch.from_arrays([*arrays, *batch.columns[2:]], [*names, *keep])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("t"), *keep)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{', ids array<int>' if with_ids else ''}"
    schema += "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return map_batches(rows, run, schema).withColumnRenamed("id", id_col)
