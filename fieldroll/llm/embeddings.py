"""Embedding near-duplicates by iterative quantisation.

A rotation that balances 64 bits is learned on SAMPLE vectors at most (those with the smallest hash of
the id); every vector is coded and indexed. Codes are cut into BLOCKS substrings, and vectors meet in a
table for each pair of substrings (multi-index Hamming tables): codes at BLOCKS - 2 differing bits or
fewer always meet, others with the chance that two substrings are clean. Pairs that meet and whose codes
differ in MOST_BITS or fewer are ranked by the cosine of the original vectors in double precision.

A pair counts in the table of its first two clean substrings only, so links are counted without a list
of pairs: each group sends on, for each of its vectors, the number of links and one link of a spanning
forest. Equal vectors are one node with a multiplicity. Measured recall stands in the README.

Vectors of each length meet among themselves: a rotation is learned for each length that LEARNED vectors of
the sample have, and others are coded by the signs of random directions, which are the same in every task.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing and are
their own component, and so are vectors of different lengths to each other; an empty table gives an empty
result; equal ids count as different vectors; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import Forest, dealt, map_groups, ranges
from .common import map_batches, written
from .components import components

BITS = 64
BLOCKS = 8
SAMPLE = 10_000
#: Vectors of a length in the sample from which a rotation is learned for it.
LEARNED = 128
ROUNDS = 50
MOST_BITS = 26
CHUNK = 512
PAIRS = list(combinations(range(BLOCKS), 2))


class Rotation:
    """center and matrix: a vector's bits are the signs of (unit vector - center) @ matrix."""

    def __init__(self, center: np.ndarray, matrix: np.ndarray):
        self.center, self.matrix = center, matrix

    @classmethod
    def learned(cls, vectors: np.ndarray, seed: int = 7) -> Rotation:
        """Iterative quantisation: turn the principal axes so that signs lose least."""
        random = np.random.default_rng(seed)
        center = vectors.mean(0)
        x = vectors - center
        wide = x.shape[1]
        if wide >= BITS:
            axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :BITS]
        else:
            axes = random.standard_normal((wide, BITS))
        v = x @ axes
        turn = np.linalg.qr(random.standard_normal((BITS, BITS)))[0]
        for _ in range(ROUNDS):
            signs = np.where(v @ turn >= 0, 1.0, -1.0)
            a, _, b = np.linalg.svd(signs.T @ v)
            turn = (a @ b).T
        return cls(center, axes @ turn)

    @classmethod
    def drawn(cls, wide: int) -> Rotation:
        """Random directions for vectors of this length."""
        return cls(np.zeros(wide), np.random.default_rng(wide).standard_normal((wide, BITS)))

    def codes(self, units: np.ndarray) -> np.ndarray:
        bits = (units - self.center) @ self.matrix >= 0
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]


def usable(lists: list) -> dict[int, list[int]]:
    """By length, the places of the vectors that may link."""
    out: dict[int, list[int]] = {}
    for i, v in enumerate(lists):
        if v and None not in v:
            a = np.asarray(v, np.float64)
            if np.isfinite(a).all() and a.any():
                out.setdefault(len(v), []).append(i)
    return out


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(1, keepdims=True))


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> dict[int, Rotation]:
    """Rotations by length, learned on at most `sample` vectors in all."""
    own = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].alias("v")).where("v is not null")
    got = own.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow().column("v").to_pylist()
    return {wide: Rotation.learned(unit(np.array([got[i] for i in places], np.float64))) for wide, places in usable(got).items() if len(places) >= LEARNED}


def coded(vectors: DataFrame, rotations: dict[int, Rotation], id_col: str, vector_col: str) -> DataFrame:
    """id, content (a digest of the vector; null if it may not link), code, v."""
    shared = vectors.sparkSession.sparkContext.broadcast(rotations)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(1).to_pylist()
        content, codes = [None] * len(lists), np.zeros(len(lists), np.int64)
        for wide, places in usable(lists).items():
            x = np.array([lists[i] for i in places], np.float64) + 0.0
            codes[places] = (shared.value.get(wide) or Rotation.drawn(wide)).codes(unit(x)).view(np.int64)
            for i, row in zip(places, x):
                content[i] = hashlib.sha1(row.tobytes()).digest()
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary()), pa.array(codes), batch.column(1)], ["id", "content", "code", "v"])

    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].alias("v"))
    return map_batches(rows, run, f"id long, content binary, code long, v {rows.schema['v'].dataType.simpleString()}")


def byte_masks() -> list[int]:
    wide = BITS // BLOCKS
    own = [((1 << wide) - 1) << wide * k for k in range(BLOCKS)]
    return [m - (1 << 64) if (m := own[i] | own[j]) >= 1 << 63 else m for i, j in PAIRS]


def linked(codes: np.ndarray, units: np.ndarray, times: np.ndarray, table: np.ndarray, low: np.ndarray, high: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Labels of components and numbers of links, over the pairs (i, j) with low[i] <= j < high[i]."""
    n = len(codes)
    forest, count = Forest(n), np.zeros(n)
    number = np.full((BLOCKS, BLOCKS), -1)
    for k, (i, j) in enumerate(PAIRS):
        number[i, j] = k
    many = np.maximum(0, high - low)
    upto = np.cumsum(many)
    at = 0
    while at < n:
        last = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + (1 << 16), side="right")))
        own = many[at:last]
        a = np.repeat(np.arange(at, last), own)
        b = np.arange(len(a)) - np.repeat(np.cumsum(own) - own, own) + low[a]
        at = last
        apart = codes[a] ^ codes[b]
        near = np.bitwise_count(apart) <= MOST_BITS
        a, b, apart = a[near], b[near], apart[near]
        if not len(a):
            continue
        clean = apart.view(np.uint8).reshape(-1, 8) == 0
        first = clean.argmax(1)
        clean[np.arange(len(a)), first] = False
        mine = number[first, clean.argmax(1)] == table[a]
        a, b = a[mine], b[mine]
        close = np.einsum("ij,ij->i", units[a], units[b]) >= least
        a, b = a[close], b[close]
        count += np.bincount(a, times[b], n) + np.bincount(b, times[a], n)
        forest.link(a, b)
    return forest.label, count.astype(np.int64)


def near_duplicates(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """id, n_links, component_id, kept for every row."""
    rows = written(coded(vectors, fit(vectors, id_col, vector_col, sample), id_col, vector_col), "coded")
    first = [F.first(c).alias(c) for c in ("code", "v")]
    nodes = rows.where("content is not null and id is not null").groupBy("content").agg(F.min("id").alias("node"), F.count("*").alias("times"), *first)
    nodes = written(nodes, "vectors")
    tables = F.array(*(F.struct(F.lit(k).alias("t"), F.col("code").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(byte_masks())))
    spread = nodes.select("node", "times", "code", "v", F.size("v").alias("wide"), F.inline(tables))

    def run(table: pa.Table, cuts: np.ndarray) -> pa.Table | None:
        sizes = np.diff(cuts)
        pick = np.repeat(sizes > 1, sizes)
        if not pick.any():
            return None
        table = table.filter(pa.array(pick))
        get = lambda name: table.column(name).to_numpy()
        own = np.concatenate([[0], np.cumsum(sizes[sizes > 1])])
        low, high = ranges(own, get("first"), get("second"), get("side"))
        vectors_ = table.column("v").combine_chunks()
        wide, flat = get("wide"), vectors_.flatten().to_numpy().astype(np.float64)
        units = np.zeros((table.num_rows, int(wide.max())))  # zeros beyond a vector's end: only vectors of one length meet
        units[np.arange(units.shape[1]) < wide[:, None]] = flat
        label, count = linked(get("code").view(np.uint64), unit(units), get("times").astype(float), get("t"), low, high, least)
        node, some = get("node"), np.flatnonzero(count)
        return pa.table({"a": node[some], "b": node[label[some]], "n": count[some]}) if len(some) else None

    found = map_groups(dealt(spread, ["t", "key", "wide"], "node", CHUNK), ["t", "key", "wide", "first", "second"], run, "a long, b long, n long", about=1 << 14)
    found = written(found.groupBy("a", "b").agg(F.sum("n").alias("n")), "found")
    of = components(found.select("a", "b"))
    links = found.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "node")
    known = nodes.select("content", "node", "times").join(links, "node", "left").join(of, "node", "left")
    known = known.select("content", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    every = rows.select("id", "content").join(known, "content", "left")
    out = every.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
