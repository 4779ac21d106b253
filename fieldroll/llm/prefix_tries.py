"""A trie of conversation prefixes from double-array tries of prefix shards.

A conversation is a path: its turns in order, each a digest of role and text with the text's length. Paths
are range-partitioned and sorted, so that a range is a prefix shard: it shares nodes with others only along
the paths at its edges, however many conversations begin alike. A task cuts its sorted paths into tries of
TRIE_CELLS cells, numbers each one's distinct turns densely, packs BASE and CHECK arrays, and traverses them
for the nodes. All that is kept of a node is a sum or a minimum, so that the few upper nodes that shards
share ("open" ones) are merged by key afterwards; what neighbouring ranges both counted is taken off again
where their edge paths agree. Digests of the members that end at a node are streamed in order of id, across
ranges where a group of equal conversations is larger than one.

Of a conversation 20 bytes a turn have to fit a task; groups of equal conversations don't.

Defined results: a null role or text is empty, a null turn comes first, equal turn numbers go by role, then
by the text's digest; rows without conv_id belong to no conversation; repeated rows are turns of their own;
an empty table gives an empty result (no root); extra columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_crc, written

#: Paths times the turns of the longest that one double-array trie holds, at most (or one path).
TRIE_CELLS = 1 << 19
#: Open nodes up to which they are broadcast (some 5 MB); beyond, a join by key.
BROADCAST_ROWS = 100_000
#: Contract: conversations take their first turns from the first of their hundred, fewer than six.
HUNDRED, MOST_SHARED = 100, 6
UNIT = np.dtype([("digest", "S16"), ("length", ">u4")])
NODE = "key binary, parent binary, depth bigint, n_convs bigint, conv_id bigint, n_children bigint, n_leaves bigint, given bigint, once bigint, ends string, open boolean, parent_open boolean, parent_conv_id bigint"
RECORD = f"kind int, {NODE}, first binary, last binary, first_id bigint, ids string"
NO_ENDS = hashlib.sha256(b"").hexdigest()


class DoubleArray:
    """A trie over sequences of codes 1..n: state s goes by code c to base[s] + c, if check holds s there."""

    def __init__(self, size: int):
        self.base, self.check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        self.check[0] = 0  # the root
        self.free = 1  # no state below this one is free
        self.top = 0  # the last that is taken

    def _grow(self, size: int) -> None:
        if size > len(self.base):
            size = max(size, 2 * len(self.base))
            self.base = np.concatenate([self.base, np.zeros(size - len(self.base), np.int64)])
            self.check = np.concatenate([self.check, np.full(size - len(self.check), -1, np.int64)])

    def place(self, state: int, codes: np.ndarray) -> None:
        """Gives state its transitions: the first place where all of codes (rising) are free."""
        low, high = int(codes[0]), int(codes[-1])
        while self.free < len(self.check) and self.check[self.free] >= 0:
            self.free += 1
        base = max(0, self.free - low)
        tries = 0
        while True:
            self._grow(base + high + 1)
            taken = self.check[base + codes] >= 0
            if not taken.any():
                break
            tries += 1
            base = base + 1 if tries < 64 else max(base + 1, self.top + 1 - low)  # behind all states it is free
        self.base[state] = base
        self.top = max(self.top, base + high)
        self.check[base + codes] = state

    def go(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The next states; -1 where there is none."""
        to = self.base[states] + codes
        inside = to < len(self.check)
        found = inside & (self.check[np.where(inside, to, 0)] == states) & (codes > 0)
        return np.where(found, to, -1)


@dataclass
class Packed:
    """A double array, each path's states (a row a path, -1 beyond its end) and its depths' states."""

    trie: DoubleArray
    states: np.ndarray
    depths: list[np.ndarray]


def packed(paths: list[np.ndarray]) -> tuple[Packed, np.ndarray, np.ndarray]:
    """paths: arrays of UNIT. Also the distinct units and each path's codes (0 beyond its end)."""
    lengths = np.array([len(p) for p in paths])
    flat = np.frombuffer(b"".join(p.tobytes() for p in paths), "V20")  # concatenate() would swap the lengths' bytes
    units, first, code = np.unique(flat, return_index=True, return_inverse=True)
    rank = np.empty(len(units), np.int64)
    rank[np.argsort(first)] = np.arange(1, len(units) + 1)  # dense, in order of appearance: siblings lie close
    codes = np.zeros((len(paths), int(lengths.max(initial=0))), np.int64)
    codes[np.arange(codes.shape[1]) < lengths[:, None]] = rank[code]
    trie = DoubleArray(2 * (len(units) + 2))
    states = np.full((len(paths), codes.shape[1] + 1), -1, np.int64)
    states[:, 0] = 0
    depths = [np.zeros(1, np.int64)]
    for d in range(codes.shape[1]):
        on = np.flatnonzero(lengths > d)
        both = np.unique(np.stack([states[on, d], codes[on, d]], 1), axis=0)
        edges = np.flatnonzero(np.diff(both[:, 0], prepend=-1))
        for a, b in zip(edges, [*edges[1:], len(both)]):
            trie.place(int(both[a, 0]), both[a:b, 1])
        depths.append(trie.go(both[:, 0], both[:, 1]))
        states[on, d + 1] = trie.go(states[on, d], codes[on, d])
    return Packed(trie, states, depths), units[np.argsort(first)], codes


def child_key(parent: bytes, unit: bytes) -> bytes:
    return hashlib.sha256(parent + unit).digest()[:16]


ROOT = hashlib.sha256(b"root").digest()[:16]


def path_key(path: bytes) -> bytes:
    key = ROOT
    for at in range(0, len(path), UNIT.itemsize):
        key = child_key(key, path[at : at + UNIT.itemsize])
    return key


def shared(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with alike."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return (int(differ[0]) if len(differ) else n) // UNIT.itemsize


def trie_nodes(paths: list[bytes], counts: list[int], least: list[int], before: bytes | None) -> dict[str, list]:
    """Columns of NODE (without ends) for a shard of distinct sorted paths, the last path being `before`."""
    own, units, codes = packed([np.frombuffer(p, UNIT) for p in paths])
    trie, states = own.trie, own.states
    size, n = len(trie.check), len(paths)
    lengths = np.array([len(p) // UNIT.itemsize for p in paths])
    text_length = np.concatenate([[0], units.view(UNIT)["length"].astype(np.int64)])
    last = states[np.arange(n), lengths]

    fresh, of_code = np.ones(size, bool), np.zeros(size, np.int64)
    for d in range(1, states.shape[1]):
        on = lengths >= d
        of_code[states[on, d]] = codes[on, d - 1]
    edge = shared(before, paths[0]) if before is not None else -1
    fresh[states[0, : edge + 1]] = False  # counted with the path before
    members, smallest, leaves = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64)
    members[last] = counts
    smallest[last] = least
    extended = states[np.arange(1, n), np.minimum(lengths[:-1], lengths[1:])] == last[:-1]
    leaves[last] = 1 - np.append(extended, False)
    if before is not None and edge == len(before) // UNIT.itemsize:
        leaves[states[0, edge]] -= 1  # the path before had counted as a leaf
    once, given, children = np.where(fresh, text_length[of_code], 0), np.zeros(size, np.int64), np.zeros(size, np.int64)
    for level in own.depths[:0:-1]:
        up = trie.check[level]
        np.add.at(members, up, members[level])
        np.minimum.at(smallest, up, smallest[level])
        np.add.at(leaves, up, leaves[level])
        np.add.at(children, up, fresh[level])
        given[level] += members[level] * text_length[of_code[level]]
        np.add.at(given, up, given[level])
        np.add.at(once, up, once[level])
    open_ = np.zeros(size, bool)
    open_[states[0, : (edge if before is not None else lengths[0]) + 1]] = True
    open_[states[-1, : lengths[-1] + 1]] = True
    keys: dict[int, bytes] = {0: ROOT}
    text = [u.tobytes() for u in units]
    for level in own.depths[1:]:
        for s, up, code in zip(level.tolist(), trie.check[level].tolist(), of_code[level].tolist()):
            keys[s] = child_key(keys[up], text[code - 1])
    order = np.concatenate(own.depths)
    depth = np.repeat(np.arange(len(own.depths)), [len(x) for x in own.depths])
    up = trie.check[order]  # the root's is the root
    columns = {"key": [keys[s] for s in order.tolist()], "parent": [keys[s] if d else None for s, d in zip(up.tolist(), depth)], "depth": depth}
    columns |= {"n_convs": members[order], "conv_id": smallest[order], "n_children": children[order], "n_leaves": leaves[order], "given": given[order], "once": once[order]}
    near = ~open_[up]
    columns |= {"open": open_[order], "parent_open": ~near & (depth > 0), "parent_conv_id": pa.array(smallest[up], mask=~near)}
    return columns | {"end_of": dict(zip(last.tolist(), paths)), "state": order}


def records(rows: dict[str, list], n: int, kind: int) -> pa.RecordBatch:
    schema = pa.schema([("kind", pa.int32()), *((c.strip().split(" ")[0], {"binary": pa.binary(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}[c.strip().split(" ")[1]]) for c in RECORD.split(",")[1:])])
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()) if f.name == "kind" else pa.array(rows[f.name], f.type) if f.name in rows else pa.nulls(n, f.type) for f in schema], schema=schema)


NODES, PARTS, EDGES = 0, 1, 2


def shards(batches: Iterator[pa.RecordBatch], cells: int = TRIE_CELLS) -> Iterator[pa.RecordBatch]:
    """From one range of sorted (path, conv_id): nodes of its tries, ids of its outer groups, its edge paths."""
    held: list[tuple[bytes, int, int]] = []  # path, members, the smallest
    ends: dict[bytes, str] = {}  # digests of groups that lie within the range
    before = first = path = None
    pieces: list[tuple[int, int, str]] = []  # of the group at hand: smallest id, number, ids
    longest = 0

    def settled() -> pa.RecordBatch:
        nonlocal before, longest
        columns = trie_nodes(*map(list, zip(*held)), before)
        end_of = columns.pop("end_of")
        columns["ends"] = [ends.get(end_of.get(s)) for s in columns.pop("state").tolist()]
        before, longest = held[-1][0], 0
        ends.clear()
        held.clear()
        return records(columns, len(columns["key"]), NODES)

    def closed(final: bool) -> Iterator[pa.RecordBatch]:
        """The group at hand is whole, or goes on in the next range."""
        nonlocal longest
        if path == first or final:
            key = path_key(path)
            yield records({"key": [key] * len(pieces), "first_id": [p[0] for p in pieces], "ids": [p[2] for p in pieces]}, len(pieces), PARTS)
        turns = len(path) // UNIT.itemsize + 1
        if held and (len(held) + 1) * max(longest, turns) > cells:
            yield settled()
        if path != first and not final:
            ends[path] = hashlib.sha256(",".join(p[2] for p in pieces).encode()).hexdigest()
        longest = max(longest, turns)
        held.append((path, sum(p[1] for p in pieces), pieces[0][0]))
        pieces.clear()

    for batch in batches:
        paths, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        start = 0
        while start < len(paths):
            stop = start + 1
            while stop < len(paths) and paths[stop] == paths[start]:
                stop += 1
            if paths[start] != path:
                if path is not None:
                    yield from closed(False)
                path = paths[start]
                first = path if first is None else first
            pieces.append((ids[start], stop - start, ",".join(map(str, ids[start:stop]))))
            start = stop
    if path is not None:
        yield from closed(True)
        yield settled()
        yield records({"first": [first], "last": [path]}, 1, EDGES)


def taken_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (before, first): what two neighbouring ranges both counted of the nodes that their edge paths share."""
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n = shared(a, b)
            units = np.frombuffer(b, UNIT)[:n]
            later = np.concatenate([np.cumsum(units["length"][::-1].astype(np.int64))[::-1], [0]])  # from each depth's turn on
            keys = [ROOT]
            for u in units:
                keys.append(child_key(keys[-1], u.tobytes()))
            depth = np.arange(n + 1)
            once = np.concatenate([later[:1], later[:-1]])
            leaf = -int(n == len(a) // UNIT.itemsize)
            columns = {"key": keys, "parent": [None, *keys[:-1]], "depth": depth, "n_convs": np.zeros(n + 1, np.int64), "n_children": -(depth < n).astype(np.int64)}
            columns |= {"n_leaves": np.full(n + 1, leaf), "given": np.zeros(n + 1, np.int64), "once": -once, "open": [True] * (n + 1), "parent_open": [d > 0 for d in depth]}
            yield records(columns, n + 1, NODES)


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and the digest of its ids, from parts in order of key and first_id."""
    key = own = None
    out: list[tuple[bytes, str]] = []
    for batch in batches:
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k == key:
                own.update(b"," + ids.encode())
            else:
                if key is not None:
                    out.append((key, own.hexdigest()))
                key, own = k, hashlib.sha256(ids.encode())
        if out:
            yield pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in out], pa.binary()), "ends": [d for _, d in out]})
            out = []
    if key is not None:
        yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends": [own.hexdigest()]})


def unit(role: Column, text: Column) -> Column:
    """A turn as 40 hex digits: 128 bits of the digest of role and text, and the text's length in code points."""
    whole = F.concat_ws("", F.length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.substring(F.sha2(whole.cast("binary"), 256), 1, 32), F.lpad(F.hex(F.length(text)), 8, "0"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id and path of every conversation: the first turns of its hundred's first, then its own from there on."""
    role, text = (F.coalesce(turns[c], F.lit("")) for c in ("role", "text"))
    own = turns.where(turns["conv_id"].isNotNull())
    own = own.select(turns["conv_id"].alias("c"), (turns["conv_id"] - turns["conv_id"] % HUNDRED).alias("head"), F.struct(turns["turn"].isNotNull().alias("known"), F.coalesce(turns["turn"], F.lit(0)).alias("turn"), role.alias("role"), unit(role, text).alias("unit")).alias("t"))
    # One shuffle: conversations and their hundred's first meet by head.
    whole = own.repartition("head").groupBy("head", "c").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["unit"]).alias("units"))
    first = F.first(F.when(F.col("c") == F.col("head"), F.slice("units", 1, MOST_SHARED)), ignorenulls=True).over(Window.partitionBy("head"))
    whole = whole.withColumns({"first": F.coalesce(first, F.array().cast("array<string>")), "h": (id_crc("c") % MOST_SHARED).cast("int")})
    rest = F.when(F.size("units") > F.col("h"), F.slice("units", F.col("h") + 1, F.size("units"))).otherwise(F.array().cast("array<string>"))
    return whole.select(F.col("c").alias("conv_id"), F.unhex(F.array_join(F.concat(F.slice("first", 1, F.col("h")), rest), "")).alias("path"))


def trie(paths: DataFrame) -> DataFrame:
    """paths: conv_id and path. conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node."""
    sorted_paths = written(paths, "paths").repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").select("path", "conv_id")
    found = written(sorted_paths.mapInArrow(shards, RECORD), "tries")
    nodes = found.where(F.col("kind") == NODES).select(*(c.strip().split(" ")[0] for c in NODE.split(",")))
    edges = found.where(F.col("kind") == EDGES).select(F.lag("last").over(Window.orderBy("first", "last")).alias("before"), "first").where("before IS NOT NULL")  # one row a range
    off = edges.mapInArrow(taken_off, RECORD).select(*nodes.columns)
    parts = found.where(F.col("kind") == PARTS).repartition("key").sortWithinPartitions("key", "first_id").select("key", "ids")
    ends = parts.mapInArrow(digests, "key binary, ends string")
    # What shards share: open nodes by key.
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "given", "once")]
    merged = nodes.where("open").union(off).unionByName(ends, allowMissingColumns=True).groupBy("key")
    merged = written(merged.agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums, F.max("ends").alias("ends")), "open-nodes")
    small = merged.count() <= BROADCAST_ROWS
    above = merged.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below = merged.unionByName(nodes.where("NOT open AND parent_open").select(*merged.columns))
    below = below.join(F.broadcast(above) if small else above, "parent", "left")
    every = below.unionByName(nodes.where("NOT open AND NOT parent_open").select(*below.columns))
    return every.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("given") - F.col("once")).alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations: see trie."""
    return trie(rebuilt(turns))
