"""Language identification as inference of a multilingual mixture.

Learning counts hashed character n-grams (1 to ORDER, with word edges, of whole runs of letters) per language over all labelled
rows: each task adds up its own counts, and only the sums per language and bucket are shuffled, at
most BUCKETS of them per language. The model is one float table of that bound.

For a text, expectation-maximisation estimates the share of each language from the n-gram likelihoods
of its words. The language set is chosen by likelihood less PENALTY * log(words) for each language beyond
the first: languages join it in the order of their shares, as long as each is given LEAST_WORDS of the text's
words, and the best set is kept, whose shares are estimated again. The prediction is the set's language with
the largest share, the score its share of the text times its posterior weight among the words.

Defined results: a null text, and one without a letter, gives `und`, score 0 and no languages; an empty table gives
an empty result; ties go to the alphabetically first language; repeated rows give repeated results;
other columns are ignored. Without a labelled row every text gives `und`.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CACHE_CHARACTERS, gram_blocks, gram_sums, map_batches

ORDER = 3
BUCKETS = 1 << 16
SMOOTHING = 0.5
ROUNDS = 8
#: Each letter counts in ORDER n-grams, so that a likelihood is about that power of one over letters.
PENALTY = float(ORDER)
#: A language joins a text's set only if it is given so many of its words.
LEAST_WORDS = 1.0
UNKNOWN = "und"

#: Runs of letters: not of what else \w takes for such (fractions, powers, circled and Roman numbers).
words_of = regex.compile(r"\p{L}+").findall


class Model:
    """Log likelihoods of n-gram buckets: table[bucket, language]."""

    def __init__(self, langs: list[str], table: np.ndarray):
        self.langs, self.table = langs, table

    @classmethod
    def of_counts(cls, rows: list[tuple[str, int, int]]) -> Model:
        langs, buckets, counts = zip(*rows) if rows else ((), (), ())
        return cls.of_table(pa.table({"lang": pa.array(langs, pa.string()), "bucket": pa.array(buckets, pa.int32()), "n": pa.array(counts, pa.int64())}))

    @classmethod
    def of_table(cls, rows: pa.Table) -> Model:
        """rows: lang, bucket, n, each pair of the first two once."""
        langs = sorted(rows.column("lang").unique().to_pylist())
        table = np.full((BUCKETS, len(langs)), SMOOTHING)
        if langs:
            column = pc.index_in(rows.column("lang"), pa.array(langs, rows.schema.field("lang").type)).to_numpy()
            table[rows.column("bucket").to_numpy(), column] += rows.column("n").to_numpy()
            table = np.log(table / table.sum(0)).astype(np.float32)
        return cls(langs, table)


class Scorer:
    """A worker's model with its cache of words."""

    def __init__(self, model: Model):
        self.model = model
        self.rows = np.zeros((1024, max(1, len(model.langs))), np.float32)
        self.index: dict[str, int] = {}
        self.characters = 0

    def number(self, words: list[str]) -> None:
        """Gives words that are new a row of log likelihoods in self.rows."""
        used = len(self.index)
        while used + len(words) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        columns = [self.model.table[:, k] for k in range(len(self.model.langs))]
        self.rows[used : used + len(words), : len(columns)] = gram_sums(words, columns, 1, ORDER, BUCKETS).T
        self.characters += sum(map(len, words))
        self.index.update(zip(words, range(used, used + len(words))))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[list[tuple[str, float]]]]:
        """For each text the language, its score, and the language set with its shares, the largest first."""
        langs, out, scores = self.model.langs, [UNKNOWN] * len(texts), [0.0] * len(texts)
        sets: list[list[tuple[str, float]]] = [[] for _ in texts]
        if not langs:
            return out, scores, sets
        held: list[tuple[int, Counter]] = []
        waiting = 0
        for i, text in enumerate(texts):
            if own := Counter(words_of(text.lower())):
                held.append((i, own))
                waiting += len(own)
            if waiting > 100_000:
                self.settle(held, out, scores, sets)
                held, waiting = [], 0
        if held:
            self.settle(held, out, scores, sets)
        return out, scores, sets

    def settle(self, held: list[tuple[int, Counter]], out: list[str], scores: list[float], sets: list) -> None:
        """Expectation-maximisation for many texts at once, on their distinct words and counts."""
        if len(self.index) > 200_000 or self.characters > CACHE_CHARACTERS:
            self.index.clear()
            self.characters = 0
        if new := list(dict.fromkeys(w for _, own in held for w in own if w not in self.index)):
            self.number(new)
        langs = self.model.langs
        lengths = np.array([len(own) for _, own in held])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        size = int(lengths.sum())
        rows = np.fromiter((n for _, own in held for n in map(self.index.__getitem__, own)), np.int64, size)
        times = np.fromiter((n for _, own in held for n in own.values()), np.float32, size)
        logs = np.ascontiguousarray(self.rows[rows].T)
        logs -= logs.max(0)
        like = np.exp(np.maximum(logs, -30))
        alone = np.add.reduceat((logs * times).astype(np.float64), starts, axis=1)
        total = np.add.reduceat(times, starts)
        every = np.arange(len(held))
        share, _ = self.mix(like, times, starts, lengths, total, np.full((len(langs), len(held)), 1 / len(langs), np.float32))
        order = np.argsort(-share, axis=0, kind="stable")
        best = alone.argmax(0)
        kept = np.zeros_like(share)
        kept[best, every] = 1
        value = alone[best, every].copy()
        for n in range(2, len(langs) + 1):
            rivals = np.flatnonzero(share[order[n - 1], every] * total >= LEAST_WORDS)
            if not len(rivals):
                break
            first = np.zeros((len(langs), len(rivals)), np.float32)
            np.put_along_axis(first, order[:n, rivals], np.float32(1 / n), axis=0)
            take = np.concatenate([np.arange(s, s + m) for s, m in zip(starts[rivals], lengths[rivals])])
            own = np.concatenate([[0], np.cumsum(lengths[rivals])[:-1]])
            got, fits = self.mix(like[:, take], times[take], own, lengths[rivals], total[rivals], first)
            gain = fits - (n - 1) * PENALTY * np.log(total[rivals] + 1.0)
            better = gain > value[rivals] + 1e-9
            kept[:, rivals[better]], value[rivals[better]] = got[:, better], gain[better]
        pick = kept.argmax(0)
        spread = like / like.sum(0) * times
        sure = np.add.reduceat(spread, starts, axis=1)[pick, every] / total
        for (i, _), k, p, s in zip(held, pick.tolist(), kept[pick, every].tolist(), sure.tolist()):
            out[i], scores[i], sets[i] = langs[k], min(1.0, max(0.0, p * s)), [(langs[k], p)]
        for j in np.flatnonzero((kept > 0).sum(0) > 1):
            sets[held[j][0]] = [(langs[k], float(kept[k, j])) for k in np.argsort(-kept[:, j], kind="stable") if kept[k, j] > 0]

    @staticmethod
    def mix(like, times, starts, lengths, total, share) -> tuple[np.ndarray, np.ndarray]:
        """Shares of languages and log likelihood, from first shares (a column for each text)."""
        for _ in range(ROUNDS):
            part = np.repeat(share, lengths, axis=1)
            part *= like
            part *= times / np.maximum(part.sum(0), 1e-30)
            share = np.add.reduceat(part, starts, axis=1) / total
        whole = (np.repeat(share, lengths, axis=1) * like).sum(0, dtype=np.float64)
        return share, np.add.reduceat(np.log(np.maximum(whole, 1e-30)) * times, starts)


def gram_counts(labelled: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """lang, bucket, n over all rows with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = defaultdict(Counter)
        sums: dict[str, np.ndarray] = {}
        characters = 0

        def settle() -> None:
            for lang, own in words.items():
                if own:
                    times = np.fromiter(own.values(), np.int64, len(own))
                    sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    for gram, word in gram_blocks(list(own), 1, ORDER, BUCKETS):
                        sums[lang] += np.bincount(gram, times[word], BUCKETS).astype(np.int64)
            words.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words[lang].update(words_of((text or "").lower()))
                characters += len(text or "")
            if sum(map(len, words.values())) > 200_000 or characters > 4 * CACHE_CHARACTERS:
                settle()
                characters = 0
        settle()
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], ["lang", "bucket", "n"])

    rows = labelled.where(labelled[lang_col].isNotNull()).select(labelled[text_col].alias("t"), labelled[lang_col].alias("l"))
    return rows.mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of all labelled rows; what comes to the driver is BUCKETS rows per language at most."""
    return Model.of_table(gram_counts(labelled, text_col, lang_col).toArrow())


_own: list = [None, None]


def _scorer(shared) -> Scorer:
    if _own[0] is not shared.value:
        _own[:] = [shared.value, Scorer(shared.value)]
    return _own[1]


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """The columns in keep, then lang_pred, score and languages: the language set with the share of each, the largest first."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*(c.alias(n) for n, c in (keep or {}).items()), docs[text_col].alias("__text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores, sets = _scorer(shared).predict([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()])
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        each = [pa.array([x[k] for own in sets for x in own], kind) for k, kind in enumerate((pa.string(), pa.float64()))]
        languages = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(each, ["lang", "share"]))
        arrays = [*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), languages]
        return pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:-1], "lang_pred", "score", "languages"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return map_batches(rows, run, f"{kept}{', ' if kept else ''}lang_pred string, score double, languages array<struct<lang:string,share:double>>")


def accepted(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with the language found in lang_col (if there is such a column), without the rows that have none (null texts and such without a letter)."""
    shared, column = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)
    place = docs.columns.index(lang_col) if lang_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, _, _ = _scorer(shared).predict([t or "" for t in batch.column(column).to_pylist()])
            if place is not None:
                batch = batch.set_column(place, lang_col, pa.array(langs, pa.string()))
            yield batch.filter(pa.array([x != UNKNOWN for x in langs], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
