"""Alignment of two tokenizers' tokens over the same bytes, as an Arrow-native pipeline.

Side A is a byte-level BPE vocabulary file, side B a sentencepiece model. Within a task the tokens of many
texts are one list column a side: its flattened ids and their parent indices (the texts), byte ends by
cumulative sums segmented by text, and the places where both sides end by an Acero hash join on (text,
end). These cut the tokens into groups; a group's distinct ids of both sides are joined on the group, so
that a pair of ids comes once with its number of links. Links are never emitted one by one, and groups are
joined in blocks of BLOCK pairs.

Passes: (1) texts are encoded once, each text's digests and its distinct pairs go to a table in the shared
folder; (2) tasks count pairs with Table.group_by and Spark merges these partial counts; (3) each text's
pairs are looked up. The most frequent pairs, FREQUENT at most, and the highest count of each A id (one
number an entry of the vocabulary) are broadcast; rarer pairs are joined by Spark, so nothing is left out.

Defined results: texts that are null or empty, or that either side doesn't give back byte for byte (white
space and what else a model normalises), have no tokens: zeros and an empty digest; an empty table gives an
empty result; repeated rows give repeated results and count as documents of their own; other columns of the
input are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SPLIT, byte_characters
from .common import map_batches, written

#: Pairs that are broadcast with their counts: some 16 MB.
FREQUENT = 1 << 20
#: Pairs that one hash join of groups gives at most.
BLOCK = 1 << 22
#: Bytes of texts that are aligned at once; a longer text is aligned alone.
SLICE_BYTES = 1 << 18
#: Distinct pairs that a task counts before it sends them on.
HELD = 1 << 19
#: Texts above this many characters are encoded by the vocabulary's own library, which has no limit of backtracking.
LONG = 500_000
SEPARATORS = (",", "|", ";", "")


class Sides:
    """Encoders of both sides, their tokens' bytes, and texts of ids with separators."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as file:
            vocab = json.load(file)["model"]["vocab"]
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        entries = {i: bytes(map(byte_of.__getitem__, token)) for token, i in vocab.items() if all(c in byte_of for c in token)}
        self.size_a = max(vocab.values()) + 1
        self.bytes_a = pa.array([entries.get(i, b"") for i in range(self.size_a)], pa.binary())
        # In such a file ids rise with the ranks of merges, so that they can stand for them.
        ranks = {entry: i for i, entry in entries.items()}
        self.fast = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.path_a, self.whole = path_a, None
        self.model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.size_b = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(self.size_b)]
        self.bytes_b = pa.array([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)], pa.binary())
        self.texts = pa.array([f"{i}{s}" for i in range(max(self.size_a, self.size_b)) for s in SEPARATORS], pa.binary())

    def encode_a(self, text: str) -> list[int]:
        if len(text) > LONG:
            if self.whole is None:  # loaded where it is needed: it takes more memory than all the rest
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.path_a)
                self.whole.encode_special_tokens = True
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def encoded(self, texts: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        """Ids of both sides, empty where one doesn't give back a space and the text."""
        lists_a = [self.encode_a(" " + t) if t else [] for t in texts]
        lists_b = self.model.encode(texts, num_threads=1) if texts else []
        kind = pa.list_(pa.int32())
        a, b = pa.array(lists_a, kind), pa.array(lists_b, kind)
        wanted = [b" " + t.encode() if t else b"" for t in texts]
        same = [x == w == y for x, y, w in zip(joined(a, self.bytes_a), joined(b, self.bytes_b), wanted)]
        if all(same):
            return a, b
        return tuple(pa.array([x if s else [] for x, s in zip(lists, same)], kind) for lists in (lists_a, lists_b))


@lru_cache(maxsize=2)
def sides(path_a: str, path_b: str) -> Sides:
    """One per worker and pair of files."""
    return Sides(path_a, path_b)


def joined(lists: pa.ListArray, table: pa.Array) -> list[bytes]:
    """For each list of ids, the entries of table that they stand for, joined."""
    taken = pc.take(table, lists.flatten())
    buffers = taken.buffers()
    at = np.frombuffer(buffers[1], np.int32, len(taken) + 1, taken.offset * 4) if len(taken) else np.zeros(1, np.int32)
    data = memoryview(buffers[2]) if len(taken) and buffers[2] is not None else memoryview(b"")
    ends = at[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    return [bytes(data[x:y]) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]


def ends_of(lists: pa.ListArray, table: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Ids, the list of each, and its byte end within the list: a cumulative sum, segmented by list."""
    ids, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    total = pc.cumulative_sum(pc.take(pc.binary_length(table), ids).cast(pa.int64()))
    before = np.concatenate([[0], total.to_numpy(zero_copy_only=False)])[lists.offsets.to_numpy()[:-1]]
    return ids, parent, pc.subtract(total, pc.take(pa.array(before), parent))


def pairs_of(group_a: np.ndarray, ids_a: pa.Array, group_b: np.ndarray, ids_b: pa.Array, list_of: np.ndarray, size_b: int, block: int = BLOCK) -> pa.Table:
    """list, pair (a * size_b + b) and times: how many links of the list are of this pair, sorted by list and pair."""

    def distinct(group: np.ndarray, ids: pa.Array) -> pa.Table:
        own = pa.table({"group": pa.array(group), "id": ids}).group_by(["group", "id"], use_threads=False).aggregate([([], "count_all")])
        return own.sort_by("group")

    def summed(parts: list[pa.Table]) -> pa.Table:
        own = pa.concat_tables(parts).group_by(["list", "pair"], use_threads=False).aggregate([("times", "sum")])
        return own.rename_columns(["list", "pair", "times"])

    a, b = distinct(group_a, ids_a), distinct(group_b, ids_b)
    n = len(list_of)
    many_a, many_b = (np.bincount(t["group"].to_numpy(), minlength=n) for t in (a, b))
    first_a, first_b = (np.concatenate([[0], np.cumsum(m)]) for m in (many_a, many_b))
    work = np.concatenate([[0], np.cumsum(many_a * many_b)])
    parts, held, at = [], 0, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(work, work[at] + block, side="right")) - 1)
        of_b = b.slice(first_b[at], first_b[to] - first_b[at])
        step = int(first_a[to] - first_a[at]) if work[to] - work[at] <= block else max(1, block // max(1, of_b.num_rows))
        for row in range(int(first_a[at]), int(first_a[to]), max(1, step)):
            of_a = a.slice(row, min(step, int(first_a[to]) - row))
            both = of_a.join(of_b, "group", join_type="inner", left_suffix="_a", right_suffix="_b", use_threads=False)
            pair = pc.add(pc.multiply(both["id_a"].cast(pa.int64()), size_b), both["id_b"].cast(pa.int64()))
            owner = pc.take(pa.array(list_of), both["group"])
            parts.append(summed([pa.table({"list": owner, "pair": pair, "times": pc.multiply(both["count_all_a"], both["count_all_b"])})]))
            held += parts[-1].num_rows
            if held > 2 * block:
                parts = [summed(parts)]
                held = parts[0].num_rows
        at = to
    if not parts:
        return pa.table({"list": pa.array([], pa.int64()), "pair": pa.array([], pa.int64()), "times": pa.array([], pa.int64())})
    return (summed(parts) if len(parts) > 1 else parts[0]).sort_by([("list", "ascending"), ("pair", "ascending")])


ALIGNED = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>"


def aligned(own: Sides, texts: list[str | None]) -> list[pa.Array]:
    """Columns ALIGNED of each text."""
    lists_a, lists_b = own.encoded([t or "" for t in texts])
    n = len(texts)
    (ids_a, of_a, end_a), (ids_b, of_b, end_b) = ends_of(lists_a, own.bytes_a), ends_of(lists_b, own.bytes_b)
    rows = lambda of, end: pa.table({"list": of, "end": end, "at": pa.array(np.arange(len(of)))})
    both = rows(of_a, end_a).join(rows(of_b, end_b), ["list", "end"], join_type="inner", left_suffix="_a", right_suffix="_b", use_threads=False)
    last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    last_a[both["at_a"].to_numpy()] = 1
    last_b[both["at_b"].to_numpy()] = 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b  # each text's last ends meet
    list_of = of_a.to_numpy()[last_a == 1].astype(np.int64)
    n_groups = np.bincount(list_of, minlength=n)
    size_a, size_b = (np.bincount(g, minlength=len(list_of)) for g in (group_a, group_b))
    links = np.zeros(n, np.int64)
    np.add.at(links, list_of, size_a * size_b)

    # Groups in turn, A's ids before B's: each id's place and what follows it.
    offsets_a, offsets_b = lists_a.offsets.to_numpy().astype(np.int64), lists_b.offsets.to_numpy().astype(np.int64)
    before_a, before_b = (np.concatenate([[0], np.cumsum(s)]) for s in (size_a, size_b))
    codes = np.zeros(len(ids_a) + len(ids_b), np.int64)
    codes[np.arange(len(ids_a)) + before_b[group_a]] = ids_a.to_numpy().astype(np.int64) * 4 + last_a
    follows = 2 * last_b
    follows[offsets_b[1:][np.diff(offsets_b) > 0] - 1] = 3
    codes[np.arange(len(ids_b)) + before_a[group_b + 1]] = ids_b.to_numpy().astype(np.int64) * 4 + follows
    order = pa.ListArray.from_arrays(pa.array((offsets_a + offsets_b).astype(np.int32)), pa.array(codes))
    digests = [hashlib.sha256(x).hexdigest() if x else "" for x in joined(order, own.texts)]

    pairs = pairs_of(group_a, ids_a, group_b, ids_b, list_of, own.size_b)
    at = pa.array(np.searchsorted(pairs["list"].to_numpy(), np.arange(n + 1)).astype(np.int32))
    column = lambda name: pa.ListArray.from_arrays(at, pairs[name].combine_chunks().cast(pa.int64()))
    long = lambda x: pa.array(x, pa.int64())
    return [long(np.diff(offsets_a)), long(np.diff(offsets_b)), long(n_groups), long(links), pa.array(digests, pa.string()), column("pair"), column("times")]


def slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of `most` bytes together, or of one row."""
    start, held = 0, 0
    for at, n in enumerate(lengths):
        if at > start and held + n > most:
            yield start, at
            start, held = at, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


def encoded_pairs(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (a number of its own), id and ALIGNED for each text, from a table in the shared folder."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("id"), docs[text_col].alias("t"))
    schema = f"row bigint, id {rows.schema['id'].dataType.simpleString()}, {ALIGNED}"
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, texts = sides(path_a, path_b), batch.column(2).to_pylist()
        parts = []
        for start, stop in slices([len(t or "") for t in texts], SLICE_BYTES):
            part = batch.slice(start, stop - start)
            parts.append(pa.RecordBatch.from_arrays([part.column(0), part.column(1), *aligned(own, texts[start:stop])], names))
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    return written(map_batches(rows, run, schema), "aligned")


def pair_counts(texts: DataFrame) -> DataFrame:
    """pair and n: in how many texts it is linked; tasks count, Spark merges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def counted() -> pa.Table:
            own = pa.concat_tables(held).group_by("pair", use_threads=False).aggregate([("n", "sum")])
            return own.rename_columns(["pair", "n"])

        for batch in batches:
            pairs = batch.column(0).flatten()
            held.append(pa.table({"pair": pairs, "n": pa.array(np.ones(len(pairs), np.int64))}))
            n += len(pairs)
            if n > 2 * HELD:
                held = [counted()]
                n = held[0].num_rows
                if n > HELD:
                    yield from held.pop().to_batches(1 << 16)
                    n = 0
        if held:
            yield from counted().to_batches(1 << 16)

    return texts.select("pairs").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def least_frequent(counts: DataFrame, most: int) -> int:
    """The smallest power of two so that at most `most` pairs have that many texts or more."""
    sizes = {r["k"]: r["n"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count("*").alias("n")).collect()}
    k, held = 64, 0
    while k > 0 and held + sizes.get(k - 1, 0) <= most:
        k -= 1
        held += sizes.get(k, 0)
    return 1 << k


def alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", most: int = FREQUENT) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    texts = encoded_pairs(docs, path_a, path_b, id_col, text_col)
    counts = written(pair_counts(texts), "pair-counts")
    own = sides(path_a, path_b)
    size_a, size_b = own.size_a, own.size_b
    id_of = F.expr(f"pair div {size_b}").cast("int")
    best = written(counts.groupBy(id_of.alias("a")).agg(F.max("n").alias("best")), "best")  # one row an A id
    least = least_frequent(counts, most)
    frequent = counts.where(F.col("n") >= least).toArrow().sort_by("pair")
    highest = np.zeros(size_a, np.int64)
    found = best.toArrow()
    highest[found["a"].to_numpy()] = found["best"].to_numpy()
    shared = spark.sparkContext.broadcast((frequent["pair"].to_numpy(), frequent["n"].to_numpy(), highest))

    kept = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in kept) + ", n_best bigint, count_sum bigint, missed array<bigint>, missed_times array<bigint>"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, numbers, top = shared.value
        lists, times = batch.column(len(kept)), batch.column(len(kept) + 1)
        pairs, each = lists.flatten().to_numpy(), times.flatten().to_numpy()
        cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        at = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
        hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
        n = np.where(hit, numbers[at], 0) if len(known) else np.zeros(len(pairs), np.int64)
        sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[cuts])
        is_best = hit & (n == top[pairs // size_b])
        missed_at = pa.array(np.concatenate([[0], np.cumsum(~hit)])[cuts].astype(np.int32))
        missed = [pa.ListArray.from_arrays(missed_at, pa.array(x[~hit])) for x in (pairs, each)]
        columns = [batch.column(k) for k in range(len(kept))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(sums(each * is_best), pa.int64()), pa.array(sums(each * n), pa.int64()), *missed], [*kept, "n_best", "count_sum", "missed", "missed_times"])

    rows = map_batches(texts.select(*kept, "pairs", "times"), run, schema)
    if least > 1:  # pairs of fewer texts than that weren't broadcast
        rows = written(rows, "looked-up")
        each = rows.select("row", F.explode(F.arrays_zip(F.col("missed").alias("pair"), F.col("missed_times").alias("times"))).alias("m")).select("row", "m.pair", "m.times")
        each = each.join(counts.where(F.col("n") < least), "pair").withColumn("a", id_of).join(F.broadcast(best), "a")
        rest = each.groupBy("row").agg(F.sum(F.expr("CASE WHEN n = best THEN times ELSE 0 END")).alias("b2"), F.sum(F.col("times") * F.col("n")).alias("s2"))
        rows = rows.join(rest, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("b2", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("s2", F.lit(0))})
    return rows.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
