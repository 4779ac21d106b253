"""Benchmark decontamination by q-gram lemma filtering.

An item of m characters that occurs in a text with at most e edits shares at least m - q + 1 - q * e of
its q-grams with it, on diagonals that differ by e at most. q is Q, or for short items the largest of which
at least one has to be shared. Each task looks a text's q-grams up in the
items' (a bitmap, then the sorted table), adds up hits in overlapping bands of 2e diagonals, keeps bands
that reach the bound, and verifies them by banded alignment. Texts are not shuffled.

Items come in blocks of BLOCK_GRAMS q-grams at most, each broadcast for one pass over the texts; so a
broadcast's size is bounded, however many items there are, and texts are read once a block.

Texts and items are compared lower-cased, with each run of other characters than letters and digits as one
space; start and end are places in that form of the text.

Defined results: null texts and items match nothing, and so do items without a letter or digit; items of less
than Q characters in that form match as whole words only; an empty table on either side gives an empty result; of an item's occurrences in a text the one of
fewest edits, then the first, is returned; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

Q = 10
#: Edits for each character of an item.
EDITS = 0.08
BLOCK_GRAMS = 1 << 20
STEP = 1 << 18
BITMAP = 22
#: Pairs of a text's q-gram and an item's that are held at once (a q-gram that a text repeats meets every place of the items that has it).
POSTINGS = 1 << 20

_others = re.compile(r"[\W_]+")


def plain(text: str | None) -> str:
    return _others.sub(" ", (text or "").lower()).strip()


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the q-grams at each place but the last q - 1."""
    factor, doubled, size = 0x100000001B3, codes.astype(np.uint64) + np.uint64(1), 1
    powers, done = {1: doubled}, None
    while 2 * size <= q:
        doubled = doubled[:-size] * np.uint64(pow(factor, size, 1 << 64)) + doubled[size:]
        size *= 2
        powers[size] = doubled
    length = 0
    for size in sorted(powers, reverse=True):
        if q - length >= size:
            part = powers[size][length:]
            done = part if done is None else done[: len(part)] * np.uint64(pow(factor, size, 1 << 64)) + part
            length += size
    mixed = done * np.uint64(0x9E3779B97F4A7C15)
    return mixed ^ (mixed >> np.uint64(29))


def edits_of(size: int) -> int:
    return int(size * EDITS + 1e-9)


def gram_of(size: int) -> int:
    """q of an item: m - q + 1 - q * e is 1 or more. Short items stand between two spaces."""
    return min(Q, size + 2 if size < Q else size // (edits_of(size) + 1))


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Items:
    """Items of one q, all short (found as whole words) or none, with their q-grams in sorted order."""

    def __init__(self, ids: list, texts: list[str], q: int, short: bool):
        self.ids, self.q, self.edge = ids, q, " " if short else ""
        self.edits = np.array([edits_of(len(t)) for t in texts], np.int64)
        self.texts = texts = [self.edge + t + self.edge for t in texts]
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.bound = self.sizes - q + 1 - q * self.edits
        hashes = [grams(codes_of(t), q) for t in texts]
        every = np.concatenate(hashes)
        item = np.repeat(np.arange(len(texts)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes])
        order = np.argsort(every, kind="stable")
        self.item, self.place = item[order], place[order]
        self.keys, self.first = np.unique(every[order], return_index=True)
        self.last = np.append(self.first[1:], len(every))
        self.bitmap = None

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places whose q-gram is an item's, and its number in keys."""
        if self.bitmap is None:
            self.bitmap = np.zeros(1 << BITMAP, bool)
            self.bitmap[(self.keys >> np.uint64(64 - BITMAP)).astype(np.int64)] = True
        at = np.flatnonzero(self.bitmap[(hashes >> np.uint64(64 - BITMAP)).astype(np.int64)])
        key = np.searchsorted(self.keys, hashes[at])
        key[key == len(self.keys)] = 0
        same = self.keys[key] == hashes[at]
        return at[same], key[same]

    def counted(self, at: np.ndarray, key: np.ndarray, doc: np.ndarray, low: int, span: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of (doc, item, band less low) that hits fall in, and the number of hits in each."""
        many = self.last[key] - self.first[key]
        posting = np.repeat(self.first[key], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        item = self.item[posting]
        band = (np.repeat(at, many) - self.place[posting]) // np.maximum(1, self.edits[item])
        code = (np.repeat(doc, many) * len(self.ids) + item) * span + (band - low)
        return np.unique(np.concatenate([code, code - 1]), return_counts=True)

    def bands(self, at: np.ndarray, key: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(doc, item, band) of bands that reach the item's bound; band b holds diagonals from b * wide to (b + 2) * wide."""
        many = self.last[key] - self.first[key]
        upto = np.cumsum(many)
        if not len(at):
            return
        low = -int(self.place.max()) - 1
        span = int(at.max()) - low + 1
        codes, counts, start = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while start < len(at):
            stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + POSTINGS, side="right")))
            new, times = self.counted(at[start:stop], key[start:stop], doc[start:stop], low, span)
            if start:
                new, own = np.unique(np.concatenate([codes, new]), return_inverse=True)
                times = np.bincount(own, np.concatenate([counts, times]), len(new)).astype(np.int64)
            codes, counts, start = new, times, stop
        pair, shifted = codes // span, codes % span
        found = np.flatnonzero(counts >= self.bound[pair % len(self.ids)])
        for p, b in zip(pair[found].tolist(), shifted[found].tolist()):
            yield p // len(self.ids), p % len(self.ids), b + low

    def matches(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(number of the text, item, start, end, edits), from plain texts."""
        texts, at, q = [self.edge + t + self.edge for t in texts] if self.edge else texts, 0, self.q
        off = 2 * len(self.edge)
        while at < len(texts):
            own, size = [], 0
            while at < len(texts) and (not own or size + len(texts[at]) < STEP):
                own.append(at)
                size += len(texts[at])
                at += 1
            sizes = np.array([len(texts[i]) + q for i in own])
            starts = np.cumsum(sizes) - sizes
            hashes = grams(codes_of("".join(texts[i] + "\0" * q for i in own)), q)
            place, key = self.hits(hashes)
            doc = np.searchsorted(starts, place, side="right") - 1
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            for d, item, band in self.bands(place - starts[doc], key, doc):
                text, wide = texts[own[d]], max(1, int(self.edits[item]))
                if (got := self.verified(text, item, band * wide - wide, (band + 2) * wide + wide)) is not None:
                    best[d, item] = min(best.get((d, item), got), got)
            for (d, item), (edits, start, end) in sorted(best.items()):
                yield own[d], item, start, end - off, edits

    def verified(self, text: str, item: int, low: int, high: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of the item's best occurrence on diagonals low to high."""
        want, most = self.texts[item], int(self.edits[item])
        exact = text.find(want, max(0, low), max(0, high) + len(want))
        if exact >= 0:
            return 0, exact, exact + len(want)
        return aligned(codes_of(want), codes_of(text), low, high, most) if most else None


def aligned(want: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """The whole of want against a stretch of text, along diagonals low to high only: (edits, start, end), if at most `most`."""
    wide, far = high - low + 1, len(want) + len(text)
    steps = np.arange(wide)
    ends = low + steps  # the text's length before each cell, in the row of no character of want
    cost = np.where((ends >= 0) & (ends <= len(text)), 0, far)
    start = ends.copy()
    for row, c in enumerate(want, 1):
        ends = low + row + steps
        inside = (ends >= 1) & (ends <= len(text))
        differs = np.ones(wide, np.int64)
        differs[inside] = text[ends[inside] - 1] != c
        across = np.where(inside, cost + differs, far)
        down, down_start = np.append(cost[1:] + 1, far), np.append(start[1:], 0)
        better = down < across
        new, begin = np.where(better, down, across), np.where(better, down_start, start)
        new = np.where((ends >= 0) & (ends <= len(text)), new, far)
        slid = np.minimum.accumulate(new - steps)
        best = np.maximum.accumulate(np.where(new - steps == slid, steps, 0))
        cost, start = slid + steps, begin[best]
        if cost.min() > most:
            return None
    k = int(cost.argmin())
    return (int(cost[k]), int(start[k]), int(low + len(want) + k)) if cost[k] <= most else None


class Block:
    """Items of any size, grouped by q."""

    def __init__(self, ids: list, texts: list[str]):
        by: dict[tuple[int, bool], list[int]] = {}
        for k, t in enumerate(texts):
            by.setdefault((gram_of(len(t)), len(t) < Q), []).append(k)
        self.groups = [Items([ids[k] for k in own], [texts[k] for k in own], q, short) for (q, short), own in sorted(by.items())]

    def matches(self, texts: list[str]) -> Iterator[tuple[int, object, int, int, int]]:
        """(number of the text, id of the item, start, end, edits), from plain texts."""
        for items in self.groups:
            for doc, item, start, end, edits in items.matches(texts):
                yield doc, items.ids[item], start, end, edits


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Block]:
    """Items in blocks of BLOCK_GRAMS q-grams, read one after the other."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t is not null").toLocalIterator():
        if text := plain(row["t"]):
            ids.append(row["id"])
            texts.append(text)
            size += len(text)
        if size >= BLOCK_GRAMS:
            yield Block(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Block(ids, texts)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, item_id, start, end, edits: one row for each text and benchmark item found in it."""
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("t"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, item_id long, start long, end long, edits long"
    out = spark.createDataFrame([], schema)
    for number, items in enumerate(blocks_of(benchmark, item_col, item_text_col)):
        found = map_batches(rows, _matcher(spark.sparkContext.broadcast(items)), schema)
        out = out.unionByName(found) if number else found
    return out.withColumnRenamed("id", id_col)


def _matcher(shared):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        got = list(shared.value.matches([plain(t) for t in batch.column(1).to_pylist()]))
        if not got:
            return None
        doc, item, start, end, edits = zip(*got)
        arrays = [batch.column(0).take(pa.array(doc)), pa.array(item, pa.int64()), *(pa.array(x, pa.int64()) for x in (start, end, edits))]
        return pa.RecordBatch.from_arrays(arrays, ["id", "item_id", "start", "end", "edits"])

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without the rows whose text holds a benchmark item, decided row by row."""
    for items in blocks_of(benchmark, item_col, item_text_col):
        docs = docs.mapInArrow(_cleaner(docs.sparkSession.sparkContext.broadcast(items), docs.columns.index(text_col)), docs.schema)
    return docs


def _cleaner(shared, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {m[0] for m in shared.value.matches([plain(t) for t in batch.column(column).to_pylist()])}
            yield batch.filter(pa.array([i not in found for i in range(batch.num_rows)], pa.bool_())) if found else batch

    return run
