"""Toxicity scores: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the character n-grams of its distinct words (whole runs, however long), hashed to BUCKETS; each is scaled by
the log ratio of its counts in toxic and other texts, and logistic regression sets the weights. Since a
text's score is a sum over its distinct words, workers score each word once and keep it.

The classifier is fitted on at most SAMPLE labelled rows, those with the smallest hash of the id: a
documented bound, of which only the distinct words come to the driver. The model is BUCKETS floats.

Defined results: null and empty texts get the score of a text without words (the intercept's); an
empty table gives an empty result; with no labelled rows, or one class only, every score is the share
of that class; ids with several labels count once for each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CACHE_CHARACTERS, gram_blocks, gram_sums, map_batches

BUCKETS = 1 << 18
SAMPLE = 10_000
SHORTEST, LONGEST = 3, 5
ROUNDS = 60
RIDGE = 0.06
BALANCE = 0.5

words_of = re.compile(r"\w+").findall


def distinct_words(text: str | None) -> list[str]:
    return sorted(set(words_of((text or "").lower())))


class Classifier:
    """weights by bucket, already scaled by the log-count ratios; bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def words(self, words: list[str]) -> np.ndarray:
        """What each word adds to a score."""
        return gram_sums(words, [self.weights], SHORTEST, LONGEST, BUCKETS)[0]

    @classmethod
    def fitted(cls, texts: Iterable[list[str]], toxic: list[int]) -> Classifier:
        """texts: the distinct words of each; what is held are numbers, and the distinct words of all."""
        y = np.array(toxic, np.float32)
        share = float(y.mean()) if len(y) else 0.0
        none = np.zeros(BUCKETS, np.float32)
        if share in (0.0, 1.0):
            return cls(none, float(np.clip(np.log((share + 1e-6) / (1 - share + 1e-6)), -14, 14)))
        number: dict[str, int] = {}
        own = [np.fromiter((number.setdefault(w, len(number)) for w in t), np.int32, len(t)) for t in texts]
        if not number:
            return cls(none, float(np.log(share / (1 - share))))
        flat, doc = np.concatenate(own), np.repeat(np.arange(len(own), dtype=np.int32), [len(t) for t in own])
        parts = list(gram_blocks(list(number), SHORTEST, LONGEST, BUCKETS))

        def by_word(values: np.ndarray) -> np.ndarray:
            out = np.zeros(len(number))
            for gram, word in parts:
                if len(word):
                    low, high = int(word.min()), int(word.max()) + 1
                    out[low:high] += np.bincount(word - low, values[gram], high - low)
            return out

        def by_gram(values: np.ndarray) -> np.ndarray:
            out = np.zeros(BUCKETS)
            for gram, word in parts:
                out += np.bincount(gram, values[word], BUCKETS)
            return out

        def by_class(of: np.ndarray) -> np.ndarray:
            counts = by_gram(np.bincount(flat, of[doc], len(number))) + 1.0
            return counts / counts.sum()

        ratio = np.log(by_class(y) / by_class(1 - y)).astype(np.float32)
        beta, bias = np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share)))
        # Classes weighted by their shares to the power -BALANCE.
        weight = np.where(y == 1, share**-BALANCE, (1 - share) ** -BALANCE).astype(np.float32)
        weight /= weight.sum()
        step, moment, second = 0.05, np.zeros_like(beta), np.zeros_like(beta)
        for t in range(1, ROUNDS + 1):
            z = np.bincount(doc, by_word(beta * ratio)[flat], len(y)) + bias
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            error = ((p - y) * weight).astype(np.float64)
            back = np.bincount(flat, error[doc], len(number))
            gradient = (by_gram(back) * ratio).astype(np.float32) + RIDGE * beta
            moment = 0.9 * moment + 0.1 * gradient
            second = 0.99 * second + 0.01 * gradient**2
            beta -= step * (moment / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-6)
            bias -= step * float(error.sum())
        return cls(beta * ratio, bias)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, where: Column | None = None) -> Classifier:
    """Fitted on at most `sample` labelled rows that satisfy where."""
    picked = labels.where(labels[label_col].isin(0, 1)) if where is None else labels.where(labels[label_col].isin(0, 1) & where)
    picked = picked.select(picked[id_col].alias("id"), picked[label_col].alias("y"))
    picked = picked.orderBy(F.xxhash64("id"), "id", "y").limit(sample)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("t")).join(F.broadcast(picked), "id").select("t", "y")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [" ".join(distinct_words(t)) for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(sets, pa.string()), batch.column(1)], ["words", "y"])

    got = map_batches(rows, run, f"words string, y {rows.schema['y'].dataType.simpleString()}").toArrow()
    got = got.sort_by([("words", "ascending"), ("y", "ascending")])
    return Classifier.fitted((w.split(" ") if w else [] for w in got.column("words").to_pylist()), [int(y) for y in got.column("y").to_pylist()])


class Scorer:
    """A worker's classifier with its cache of words."""

    def __init__(self, model: Classifier):
        self.model, self.known, self.characters = model, {}, 0

    def scores(self, texts: list[str | None]) -> np.ndarray:
        sets = [set(words_of((t or "").lower())) for t in texts]
        if len(self.known) > 300_000 or self.characters > CACHE_CHARACTERS:
            self.known.clear()
            self.characters = 0
        if new := sorted({w for own in sets for w in own if w not in self.known}):
            self.known.update(zip(new, self.model.words(new).tolist()))
            self.characters += sum(map(len, new))
        z = np.array([sum(map(self.known.__getitem__, sorted(own))) for own in sets]) + self.model.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


_own: list = [None, None]


def _scorer(shared) -> Scorer:
    if _own[0] is not shared.value:
        _own[:] = [shared.value, Scorer(shared.value)]
    return _own[1]


def score(docs: DataFrame, model: Classifier, text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """The columns in keep, then score (0 to 1) and predicted (1 from 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*(c.alias(n) for n, c in (keep or {}).items()), docs[text_col].alias("__text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = _scorer(shared).scores(batch.column(batch.num_columns - 1).to_pylist())
        arrays = [*batch.columns[:-1], pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
        return pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:-1], "score", "predicted"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return map_batches(rows, run, f"{kept}{', ' if kept else ''}score double, predicted int")
