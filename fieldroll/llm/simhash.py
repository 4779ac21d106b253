"""SimHash near-duplicates with bit-sliced comparison.

A text's fingerprint has a bit set where over half of its word shingles' hashes have it. Fingerprints
at RADIUS bits or fewer agree on at least two of RADIUS + 2 blocks, so all pairs of blocks together give every
linked pair; distinct fingerprints meet under each of these keys. There they are stored as bit planes: word
w of plane p holds bit p of 64 fingerprints. Each plane's differences from a query are added to carry-save
counters for all 64 at once, and a word is abandoned when all of its lanes are over the radius.

Where a fingerprint of 64 bits is too coarse (deduplicated), groups are of a similarity of the shingle sets itself.
Two sets at a Jaccard similarity of t share one of the first n - ceil(t * n) + 1 of their n shingles in any one order;
texts meet under these, the bit-sliced search with a second word of 64 bits leaves the pairs that may be similar, and
a pair is linked only if its shingle sets, compared in full, are. The order puts frequent shingles (passages that many
texts share) last, so that texts meet under rare ones; a pair goes on only if what follows the shingle in both texts
leaves room for the overlap that the similarity needs, as it does at the first shingle that a similar pair shares. The
bound of the search is wide: at a similarity j about acos(2j / (1 + j)) / pi of the bits differ, some 19 of 128 at 0.8, and
pairs at 41 or fewer are compared. A bitmap of each set (a bit for each shingle's hash) then bounds a pair's overlap from
above, by the bits that only one of the two has: most pairs of a large group of loosely similar texts end here.

Only a spanning forest of each group's links goes on, so a large group of near copies sends as many rows
as it has members, and pairs already joined are not compared again. In deduplicated the forests' pairs are first compared
in full. What pairs that may be similar join is a class, with all similar pairs inside one; the sets of a class of which the first
comparison left parts apart are brought together (each chunk of them with each other), compared in full there, and again only a
spanning forest of the similar pairs goes on. Copies share a fingerprint and are
one node. Components are found by contraction.

Defined results: null and empty texts, or such of white space alone, have fingerprint zero, linked like
any other; a null id is never the smallest of its component, which is null if no id is there; an empty
table gives an empty result; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .buckets import BROADCAST_ROWS, Forest, crossed, dealt, map_groups, ranges
from .common import map_batches, written
from .components import components

SHINGLE = 4
SEED = 42
RADIUS = 4
CHUNK = 2048
#: Frequent shingles that go last in the order (broadcast, 512 KB). Which these are changes the speed alone.
FREQUENT = 1 << 16
#: Shingles that a task holds at most while it counts them (16 bytes each).
COUNTED = 1 << 18
#: Texts to be compared in full up to which their hashes are broadcast (16 bytes each); beyond, a join by hash.
BROADCAST_TEXTS = 400_000
#: 64-bit words of a set's bitmap.
MAP_WORDS = 16
#: A class's chunks hold so many shingles (8 bytes each) on average at most; it is cut into up to SPREAD_CUTS chunks, of
#: LEAST_CHUNK texts at least, so that a large one is not left to a few tasks. These change speed and memory alone.
CHUNK_SHINGLES, SPREAD_CUTS, LEAST_CHUNK = 1 << 20, 24, 64
#: Pairs compared in full between looks at what is joined by then.
COMPARED = 256
#: Planes are read in a mixed order, so that those that a key fixes don't come first.
ORDER = [p * 37 % 64 for p in range(64)]


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(joined, seed)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[: len(ends) - shingle])]
    hashes = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts, ends[shingle - 1 :])), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def shingle_set(text: str | None, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The text's distinct shingles: their 64-bit hashes in rising order, and 16 bytes of hash of each."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros((0, 16), np.uint8)
    joined, digest = b" ".join(words), xxhash.xxh3_128_digest
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[: max(0, len(ends) - shingle)])]
    flat = b"".join([digest(joined[s:e]) for s, e in zip(starts, ends[min(shingle, len(words)) - 1 :])])
    values, at = np.unique(np.frombuffer(flat, np.uint64)[::2], return_index=True)
    return values, np.frombuffer(flat, np.uint8).reshape(-1, 16)[at]


def frequent_shingles(docs: DataFrame, text_col: str, shingle: int, most: int = FREQUENT) -> np.ndarray:
    """Hashes of at most `most` frequent shingles, rarer ones first: each task counts its own texts' and sends on its heaviest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        fresh: list[np.ndarray] = []
        size = 0

        def settle() -> None:
            nonlocal values, counts, fresh, size
            new, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *fresh]), return_counts=True)
            own, at = np.unique(np.concatenate([values, new]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, times]), len(own)).astype(np.int64)
            values, fresh, size = own, [], 0
            if len(values) > COUNTED:
                keep = np.argpartition(counts, -COUNTED // 2)[-COUNTED // 2 :]
                values, counts = values[keep], counts[keep]

        for batch in batches:
            for text in set(batch.column(0).to_pylist()):
                fresh.append(shingle_set(text, shingle)[0])
                size += len(fresh[-1])
                if size > COUNTED:
                    settle()
        settle()
        top = np.argsort(-counts, kind="stable")[:most]
        top = top[counts[top] > 2]
        yield pa.RecordBatch.from_arrays([pa.array(values[top].view(np.int64)), pa.array(counts[top])], ["h", "n"])

    parts = docs.select(docs[text_col].alias("t")).mapInArrow(run, "h long, n long")
    found = parts.groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(most).toArrow()
    return found.column("h").to_numpy()[::-1].view(np.uint64)


def ordered(values: np.ndarray, last: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """values (rising) with those in `last` (rising) at the end, by their rank."""
    if not len(last):
        return values
    at = np.searchsorted(last, values)
    at[at == len(last)] = 0
    late = last[at] == values
    return np.concatenate([values[~late], values[late][np.argsort(rank[at[late]])]]) if late.any() else values


def shingled(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """id, h (hash of the text), node (hash of the set of shingles), size (of the set), fp and more (its fingerprint), prefix (its first shingles)."""
    frequent = frequent_shingles(docs, text_col, shingle)
    rank = np.argsort(frequent, kind="stable")
    shared_ = docs.sparkSession.sparkContext.broadcast((frequent[rank], rank))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, sizes, prints, prefixes = [], [], [], []
        for text in batch.column(2).to_pylist():
            values, rows = shingle_set(text, shingle)
            counts = np.zeros(128, np.int64)
            for at in range(0, len(rows), 1 << 13):
                counts += np.unpackbits(rows[at : at + (1 << 13)], axis=1, bitorder="little").sum(0, dtype=np.int64)
            nodes.append(xxhash.xxh3_64_intdigest(values.tobytes()))
            sizes.append(len(values))
            prints.append(np.packbits(2 * counts > len(rows), bitorder="little").view(np.int64))
            prefixes.append(ordered(values, *shared_.value)[: len(values) - math.ceil(similarity * len(values) - 1e-9) + 1].view(np.int64))
        words = np.array(prints, np.int64).reshape(-1, 2)
        ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
        prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes)))
        node = pa.array(np.array(nodes, np.uint64).view(np.int64))
        arrays = [*batch.columns[:2], node, pa.array(sizes, pa.int32()), pa.array(words[:, 0].copy()), pa.array(words[:, 1].copy()), prefix]
        return pa.RecordBatch.from_arrays(arrays, ["id", "h", "node", "size", "fp", "more", "prefix"])

    rows = docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(text_col).alias("h"), docs[text_col].alias("t"))
    return map_batches(rows, run, "id long, h long, node long, size int, fp long, more long, prefix array<long>")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id and fp (the 64 bits as a signed long)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["id", "fp"])

    return map_batches(docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("t")), run, "id long, fp long")


def masks(blocks: int = RADIUS + 2, same: int = 2) -> list[int]:
    """Signed masks of every choice of `same` blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    own = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [m - (1 << 64) if (m := sum(x)) >= 1 << 63 else m for x in combinations(own, same)]


def compare(values: np.ndarray, low: np.ndarray, high: np.ndarray, radius: int = RADIUS, fits: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, start: np.ndarray | None = None, spanning: list | None = None) -> np.ndarray:
    """A label for each value: the smallest row that it is linked to, through pairs (i, j) with low[i] <= j < high[i].

    fits: which of the pairs found (rows a, rows b) are linked; without it, all.
    start: labels to begin with; pairs of the same label aren't compared.
    spanning: gets a spanning forest of the links (an array of each side).
    """
    n, every = len(values), np.uint64(0xFFFFFFFFFFFFFFFF)
    width = -(-n // 64)
    bits = np.zeros((width * 64, 64), np.uint8)
    bits[:n] = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits, axis=0, bitorder="little").T).view(np.uint64)
    queries = np.ascontiguousarray(bits[:n].T).astype(bool)
    forest = Forest(n)
    if start is not None:
        forest.label = start
    some = np.flatnonzero(high > low)
    words = np.zeros(n, np.int64)
    words[some] = (high[some] - 1) // 64 - low[some] // 64 + 1
    upto = np.cumsum(words)
    counters = max(1, radius.bit_length())
    at, step = 0, 256
    while at < n:
        last = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + step, side="right")))
        q = np.repeat(np.arange(at, last), words[at:last])
        at, step = last, min(2 * step, 1 << 15)
        if not len(q):
            continue
        w = np.arange(len(q)) - np.repeat(np.concatenate([[0], np.flatnonzero(np.diff(q)) + 1]), np.diff(np.concatenate([[0], np.flatnonzero(np.diff(q)) + 1, [len(q)]]))) + low[q] // 64
        whole = np.append(forest.label, np.full(width * 64 - n, -1)).reshape(width, 64)
        same = whole.min(1)
        same[same != whole.max(1)] = -1
        fresh = same[w] != forest.label[q]
        q, w = q[fresh], w[fresh]
        skip = np.clip(low[q] - 64 * w, 0, 63).astype(np.uint64)
        end = np.clip(high[q] - 64 * w, 1, 64).astype(np.uint64)
        valid = (every << skip) & (every >> (np.uint64(64) - end))
        count = [np.zeros(len(q), np.uint64) for _ in range(counters)]
        over = np.zeros(len(q), np.uint64)
        for k, p in enumerate(ORDER, 1):
            carry = planes[p, w] ^ np.where(queries[p, q], every, np.uint64(0))
            for c in count:
                held = c & carry
                c ^= carry
                carry = held
            over |= carry
            if k >= 16 and k % 8 == 0:
                alive = valid & ~above(count, over, radius)
                keep = alive != 0
                if k == 64:
                    valid = alive
                elif not keep.all():
                    q, w, valid, over = q[keep], w[keep], valid[keep], over[keep]
                    count = [c[keep] for c in count]
                if not len(q):
                    break
        if len(q) and valid.any():
            lanes = np.unpackbits(valid.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            element, lane = np.nonzero(lanes)
            a, b = q[element], w[element] * 64 + lane
            if fits is not None:
                close = fits(a, b)
                a, b = a[close], b[close]
            found = forest.link(a, b)
            if spanning is not None:
                spanning.append(found)
    return forest.label


def above(count: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter is above the radius."""
    more, equal = over.copy(), ~over
    for k in range(len(count) - 1, -1, -1):
        if radius >> k & 1:
            equal &= count[k]
        else:
            more |= equal & count[k]
            equal &= ~count[k]
    return more


def links(nodes: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """nodes: node, fp, each fingerprint once. Links (a, b) that span the same components as all linked pairs."""
    rows = nodes.select("node", F.col("fp").alias("word"), F.posexplode(F.array(*map(F.lit, masks(radius + 2, 2)))).alias("t", "mask"))
    rows = rows.withColumn("key", F.col("word").bitwiseAND(F.col("mask"))).drop("mask")

    def run(table: pa.Table, cuts: np.ndarray) -> pa.Table | None:
        got = paired(table, cuts)
        if got is None:
            return None
        get, low, high = got
        label = compare(get("word").view(np.uint64), low, high, radius)
        node = get("node")
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": node[linked], "b": node[label[linked]]})

    return map_groups(dealt(rows, ["t", "key"], "node", chunk), ["t", "key", "first", "second"], run, "a long, b long")


def paired(table: pa.Table, cuts: np.ndarray) -> tuple | None:
    """Columns by name, and ranges, of the rows in groups of two or more."""
    sizes = np.diff(cuts)
    pick = np.repeat(sizes > 1, sizes)
    if not pick.any():
        return None
    get = lambda name: table.column(name).to_numpy()[pick]
    own = np.concatenate([[0], np.cumsum(sizes[sizes > 1])])
    return get, *ranges(own, get("first"), get("second"), get("side"))


def shared(nodes: DataFrame) -> DataFrame:
    """key, node, place (in the node's order of shingles): the shingles in prefixes of two or more nodes."""

    def run(table: pa.Table, cuts: np.ndarray) -> pa.Table | None:
        sizes = np.diff(cuts)
        pick = np.repeat(sizes > 1, sizes)
        return table.filter(pa.array(pick)) if pick.any() else None

    rows = nodes.select(F.posexplode("prefix").alias("place", "key"), "node").select("key", "node", "place")
    return map_groups(rows.repartition("key").sortWithinPartitions("key"), ["key"], run, "key long, node long, place int")


def bitmap(values: np.ndarray) -> bytes:
    """A bit for each value; several may share one."""
    bits = np.zeros(64 * MAP_WORDS, bool)
    bits[(values & np.uint64(64 * MAP_WORDS - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def bounded(get: Callable[[str], np.ndarray], left: np.ndarray, maps: np.ndarray | None, similarity: float, radius: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Which pairs of rows differ in 2 * radius + 1 of 128 bits or fewer and may be that similar: left bounds the overlap, and so do maps."""
    size, words = get("size").astype(float), [get(c).view(np.uint64) for c in ("fp", "more")]

    def fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        differ = sum(np.bitwise_count(w[a] ^ w[b]).astype(np.int64) for w in words)
        need = (similarity * (size[a] + size[b]) - 1e-9) / (1 + similarity)
        good = (differ <= 2 * radius + 1) & (np.minimum(left[a], left[b]) >= need)
        if maps is not None:
            at = np.flatnonzero(good)
            one, two = maps[a[at]], maps[b[at]]
            alone = [np.bitwise_count(x & ~y).sum(1, dtype=np.int64) for x, y in ((one, two), (two, one))]
            good[at] = np.minimum(size[a[at]] - alone[0], size[b[at]] - alone[1]) >= need[at]
        return good

    return fits


def spanned(get: Callable[[str], np.ndarray], low: np.ndarray, high: np.ndarray, radius: int, fits: Callable[[np.ndarray, np.ndarray], np.ndarray], label: np.ndarray | None = None) -> pa.Table:
    """A spanning forest (a, b) of the nodes of pairs that fit, found by either word of their fingerprints."""
    node, found = get("node"), []
    for c in ("fp", "more"):
        label = compare(get(c).view(np.uint64), low, high, radius, fits, label, found)
    a, b = (np.concatenate([p[k] for p in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    return pa.table({"a": node[a], "b": node[b]})


def candidates(rows: DataFrame, similarity: float, radius: int, chunk: int = CHUNK) -> DataFrame:
    """A spanning forest of each key's pairs (a, b) of nodes whose 128 bits differ in 2 * radius + 1 or fewer, and whose sets may be that similar.

    They may not, if the shingles from the key on are fewer than the overlap needed (of a similar pair's keys the first
    passes), or if the bitmaps show that too many are in one set only. rows: key, node, place, size, fp, more, and map if there
    are bitmaps.
    """
    mapped = "map" in rows.columns

    def run(table: pa.Table, cuts: np.ndarray) -> pa.Table | None:
        got = paired(table, cuts)
        if got is None:
            return None
        get, low, high = got
        maps = np.frombuffer(b"".join(get("map")), np.uint64).reshape(-1, MAP_WORDS) if mapped else None
        return spanned(get, low, high, radius, bounded(get, get("size") - get("place"), maps, similarity, radius))

    found = map_groups(dealt(rows, ["key"], "node", chunk), ["key", "first", "second"], run, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def alike(one: np.ndarray, two: np.ndarray, similarity: float) -> bool:
    """Whether two sets have that Jaccard similarity or more."""
    both = len(np.intersect1d(one, two, assume_unique=True))
    return both >= similarity * (len(one) + len(two) - both) - 1e-9


def similar_within(rows: DataFrame, sets: DataFrame, similarity: float, radius: int, chunk: int = CHUNK) -> DataFrame:
    """Pairs (a, b) of that similarity that join the components of a class as all of its similar pairs do.

    rows: node, loose (its class), component, size, fp, more; sets: node, set, map. Classes of one component are done. Sets
    are compared in full where they meet, and only a spanning forest of what is similar goes on.
    """
    mixed = rows.groupBy("loose").agg(F.count("*").alias("n"), F.sum("size").alias("s"), F.min("component").alias("least"), F.max("component").alias("most"))
    mixed = written(mixed.where("least < most").select("loose", "n", "s"), "mixed")
    classes_, nodes = mixed.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    spread = F.least(F.lit(SPREAD_CUTS), F.ceil(F.col("n") / max(LEAST_CHUNK, nodes // 512)))
    cut = F.greatest(F.ceil(F.col("n") / chunk), F.ceil(F.col("s") / CHUNK_SHINGLES), spread).cast("int")
    mixed = mixed.select("loose", cut.alias("__cut"))
    rows = rows.join(F.broadcast(mixed) if classes_ <= BROADCAST_ROWS else mixed, "loose").join(sets, "node")

    def run(table: pa.Table, cuts: np.ndarray) -> pa.Table | None:
        got = paired(table, cuts)
        if got is None:
            return None
        get, low, high = got
        held = [np.frombuffer(x, np.uint64) for x in get("set")]
        maps = np.frombuffer(b"".join(get("map")), np.uint64).reshape(-1, MAP_WORDS)
        bound = bounded(get, get("size"), maps, similarity, radius)
        _, at, own = np.unique(get("component"), return_index=True, return_inverse=True)
        forest = Forest(len(held))
        forest.label = at[own]

        def fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            good = np.zeros(len(a), bool)
            left = np.flatnonzero(forest.label[a] != forest.label[b])
            left = left[bound(a[left], b[left])]
            for start in range(0, len(left), COMPARED):
                part = left[start : start + COMPARED]
                part = part[forest.label[a[part]] != forest.label[b[part]]]
                part = part[np.fromiter((alike(held[x], held[y], similarity) for x, y in zip(a[part], b[part])), bool, len(part))]
                forest.link(a[part], b[part])
                good[part] = True
            return good

        return spanned(get, low, high, radius, fits, forest.label)

    return map_groups(crossed(rows, ["loose"], "node"), ["loose", "first", "second"], run, "a long, b long", 1 << 12)


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have that Jaccard similarity or more; sets: node, set (sorted 64-bit hashes as bytes)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for one, two in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            keep.append(alike(np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64), similarity))
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows = pairs.join(sets.toDF("a", "one"), "a").join(sets.toDF("b", "two"), "b").select("a", "b", "one", "two")
    return map_batches(rows, run, "a long, b long")


def similar_classes(docs: DataFrame, own: DataFrame, text_col: str, shingle: int, similarity: float, radius: int) -> DataFrame:
    """node, component: the groups of nodes joined by pairs of that similarity or more, for nodes in such pairs. own: shingled's columns, and row, a number of its own for each row."""
    nodes = written(own.groupBy("node").agg(*(F.min(c).alias(c) for c in ("row", "h", "size", "fp", "more"))), "nodes")
    # One row's prefix for each node, so that prefixes themselves are neither sorted nor aggregated.
    rows = written(shared(own.join(nodes.select("row"), "row", "left_semi")).join(nodes.select("node", "size", "fp", "more"), "node"), "shared")
    few = candidates(rows, similarity, radius)
    close = written(few.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "close")
    texts = docs.select(F.xxhash64(text_col).alias("h"), docs[text_col].alias("t"))
    wanted = nodes.select("node", "h").join(close, "node")
    texts = texts.join(F.broadcast(wanted) if close.count() <= BROADCAST_TEXTS else wanted, "h").dropDuplicates(["node"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, shingle)[0] for t in batch.column(1).to_pylist()]
        each = [pa.array([make(s) for s in sets], pa.binary()) for make in (np.ndarray.tobytes, bitmap)]
        return pa.RecordBatch.from_arrays([batch.column(0), *each], ["node", "set", "map"])

    sets = written(map_batches(texts.select("node", "t"), run, "node long, set binary, map binary"), "sets")
    near = written(candidates(rows.join(sets.select("node", "map"), "node"), similarity, radius), "near")
    # The forests' pairs in full first, so that only what they leave apart of a class (all similar pairs are inside one) meets again.
    first = written(similar(near, sets.drop("map"), similarity), "similar")
    of = components(near).withColumnRenamed("component", "loose").join(components(first), "node", "left")
    of = of.select("node", "loose", F.coalesce("component", "node").alias("component")).join(nodes.select("node", "size", "fp", "more"), "node")
    return components(first.union(similar_within(written(of, "loose"), sets, similarity, radius)))


def classes(own: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Each fingerprint with component_id, the smallest id reachable from it; own: id, fp."""
    nodes = written(own.groupBy("fp").agg(F.min("id").alias("node")), "nodes")
    found = components(links(nodes.where("node is not null"), radius))
    return nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """id, fingerprint (16 hex digits), component_id (the smallest id reachable), for every row."""
    own = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    rows = own.join(classes(own, radius), "fp")
    return rows.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 20) -> DataFrame:
    """docs with one row of each group: that of the smallest id, and of rows with that id the one whose text hashes lowest.

    Groups are joined by pairs of texts whose sets of shingles have a Jaccard similarity of `similarity` or more. Pairs whose
    fingerprints differ in over 2 * radius + 1 of 128 bits are taken to be less similar. A row without an id stays only
    if no row with one is in its group.
    """
    own = written(shingled(docs, id_col, text_col, shingle, similarity).withColumn("row", F.monotonically_increasing_id()), "shingled")
    of = similar_classes(docs, own, text_col, shingle, similarity, radius)
    group = own.select("id", "h", "node").join(of, "node", "left").groupBy(F.coalesce("component", "node"))
    kept = group.agg(F.min(F.struct(F.isnull("id").alias("no"), "id", "h")).alias("k")).select(F.col("k.id").alias("__id"), F.col("k.h").alias("__h"))
    rows = docs.withColumn("__key", F.xxhash64(text_col))
    of_row = lambda other: rows[id_col].cast("long").eqNullSafe(other["__id"]) & (rows["__key"] == other["__h"])
    rows = rows.join(kept, of_row(kept), "left_semi")
    again = own.groupBy(F.col("id").alias("__id"), F.col("h").alias("__h")).agg(F.count("*").alias("__n")).where("__n > 1")
    again = written(again, "again")
    if not again.isEmpty():  # rows with both the same id and the same text: one stays
        one = Window.partitionBy(id_col, "__key").orderBy("__key")
        first = rows.join(again, of_row(again), "left_semi").withColumn("__n", F.row_number().over(one)).where("__n = 1").drop("__n")
        rows = rows.join(again, of_row(again), "left_anti").unionByName(first)
    return rows.select(*docs.columns)
