"""Helpers that the corpus operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch: bounds a Python worker's memory when texts are very long.
BATCH_ROWS = 512


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers, unless their path has it: once per context."""
    context, root = spark.sparkContext, Path(__file__).resolve().parents[2]
    found = {Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if context.master.startswith("local["):
        found.add(Path.cwd())
    if root in found or getattr(context, "_fieldroll_sent", False):
        return
    archive = Path(tempfile.mkdtemp()) / "fieldroll.zip"
    with zipfile.ZipFile(archive, "w") as file:
        for source in sorted((root / "fieldroll").rglob("*.py")):
            file.write(source, source.relative_to(root))
    context.addPyFile(str(archive))
    context._fieldroll_sent = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; one of its own only where the driver is all there is."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir is None and (current := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        set_dir = current.get()
    if set_dir is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        set_dir = f"/tmp/checkpoints/{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df from a table in the shared folder: cuts the lineage, and lost executors don't cost its making again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, run: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """run on each Arrow batch of BATCH_ROWS rows at most."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                if (out := run(batch.slice(start, BATCH_ROWS))) is not None and out.num_rows:
                    yield out

    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 2 * BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(2 * BATCH_ROWS))
    return df.mapInArrow(each, schema)


def id_crc(column: str) -> Column:
    """crc32 of an id as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


class Memo(dict):
    """A worker's cache of make's values in two generations: when one is full, keys not used since then go."""

    def __init__(self, make: Callable, most: int = 150_000):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 256:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


#: Characters of words whose n-grams are made at once.
GRAM_BLOCK = 1 << 17
#: Characters of words that a worker's cache holds before it is emptied.
CACHE_CHARACTERS = 1 << 24


def gram_blocks(words: list[str], shortest: int, longest: int, buckets: int, block: int = GRAM_BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the character n-grams of words (whole, with edges), and each one's word, for some `block` characters at a time.

    Blocks end between words; a word of more than `block` characters has blocks of its own, each with what its last n-grams reach into.
    """
    if not words:
        return
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    at = 0
    while at < len(words):
        first = int(ends[at] - lengths[at])
        to = max(at + 1, int(np.searchsorted(ends, first + block, side="right")))
        for start in range(first, int(ends[to - 1]), block):
            stop = min(start + block, int(ends[to - 1]))
            own = codes[start : stop + longest - 1].astype(np.uint64)
            size = stop - start
            word = np.repeat(np.arange(at, to, dtype=np.int32), np.minimum(ends[at:to], stop) - np.maximum(ends[at:to] - lengths[at:to], start))
            left = ends[word] - np.arange(start, stop)  # characters up to the word's end
            found, of = [], []
            value = np.zeros(size, np.uint64)
            for n in range(1, longest + 1):
                ahead = np.zeros(size, np.uint64)
                part = own[n - 1 : n - 1 + size]
                ahead[: len(part)] = part
                value = value * np.uint64(0x100000001B3) + ahead + np.uint64(n)
                if n >= shortest:
                    whole = left >= n
                    mixed = value[whole] * np.uint64(0x9E3779B97F4A7C15)
                    found.append(((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32))
                    of.append(word[whole])
            yield np.concatenate(found), np.concatenate(of)
        at = to


def word_grams(words: list[str], shortest: int, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all character n-grams of words, and each one's word."""
    parts = list(gram_blocks(words, shortest, longest, buckets)) or [(np.zeros(0, np.int32), np.zeros(0, np.int32))]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def gram_sums(words: list[str], weights: list[np.ndarray], shortest: int, longest: int, buckets: int) -> np.ndarray:
    """For each array of weights by bucket, the sum over each word's n-grams."""
    out = np.zeros((len(weights), len(words)))
    for gram, word in gram_blocks(words, shortest, longest, buckets):
        low, high = (int(word.min()), int(word.max()) + 1) if len(word) else (0, 0)
        for k, own in enumerate(weights):
            out[k, low:high] += np.bincount(word - low, own[gram], high - low)
    return out
