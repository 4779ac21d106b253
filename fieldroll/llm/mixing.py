"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Each source is a queue of its documents in a shuffled order that depends on ids alone, passed through up to
`passes` times. A document's virtual finish time is the number of its source's words up to its end, divided
by the source's weight. All passes of all documents are range-sorted by it and cut at the budget, so that at
any place of the order the sources have given words by their weights, and sources that run out leave the
rest to the others. What a source has given when all budget is spent is its target; the document that it is
giving then gives the words that are due by then.

Sizes: a source with a third of all documents is split into as many buckets as the square root of its
number of documents; sums of buckets give offsets, so that neither level holds more than that root.
Sources, of any number, are ranked and filled in ranges too (see running). The cut is one row, looked for
in the one range in which the budget ends.

Defined results: a null text has 0 words; documents without a word take nothing; documents without a source
are a source of their own, the last; repeated rows are documents of their own; ties in the shuffled order go
by id, then size, and equal rows may stand for each other; an empty table gives an empty result; extra
columns of any name are left out of the work and of the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .running import offsets, ranged, running

#: Weights of sources in code point order, repeating; share of all words; passes through a source.
WEIGHTS = (5, 2, 1)
SHARE = (3, 2)
PASSES = 2
#: Fixed value: words.
WORD = r"[^\x20\x09-\x0D]+"
#: Sources up to which their table is broadcast (some 6 MB); beyond, a join by source.
BROADCAST_ROWS = 100_000


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffled(key: Column) -> Column:
    """A place in the shuffled order: 60 bits of the id's digest."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, passes: int = PASSES) -> DataFrame:
    """sources: source, source_size and other columns. Adds rank, weight, target (double) and due (its whole words).

    Sources are filled in order of size over weight: one is full if its share of what the fuller ones
    leave exceeds `passes` times its size. Shares are whole numbers until the last division.
    """
    ranked = running(sources, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)}, "source-ranks")
    place = (F.col("rank") - 1) % len(weights)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("__most", F.col("source_size") * passes)
    ranked = ranked.withColumn("__fill", F.col("__most") / F.col("weight"))
    sums = {"__full": F.col("__most"), "__used": F.col("weight")}
    filled = written(running(written(ranked, "sources"), [F.col("__fill"), F.col("rank")], sums, "source-fill"), "source-fill")
    whole = filled.agg(F.max("__full").alias("full"), F.max("__used").alias("used")).first()
    # The level once all sources before this one are full: budget left over weight left (times share[1]).
    left = F.lit((whole["full"] or 0) // passes * share[0]) - share[1] * (F.col("__full") - F.col("__most"))
    rest = share[1] * (F.lit(whole["used"] or 0) - F.col("__used") + F.col("weight"))
    filled = filled.withColumns({"__left": left, "__rest": rest})
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    level = filled.where(wide("__most") * wide("__rest") > wide("__left") * wide("weight")).orderBy("__fill", "rank").first()
    target, due = F.col("__most").cast("double"), F.col("__most")
    if level is not None:
        open_ = (F.col("__fill") > level["__fill"]) | (F.col("__fill") == level["__fill"]) & (F.col("rank") >= level["rank"])
        owed = F.col("weight") * level["__left"]
        target = F.when(open_, owed.cast("double") / float(level["__rest"])).otherwise(target)
        due = F.when(open_, F.floor(owed.cast("decimal(38,0)") / F.lit(level["__rest"]).cast("decimal(19,0)")).cast("long")).otherwise(due)
    return filled.select(*(c for c in filled.columns if not c.startswith("__")), target.alias("target"), due.alias("due"))


@dataclass(frozen=True)
class Mix:
    """queue: a row a document with its place; cut: where the budget ends; order: see `occurrences`."""

    queue: DataFrame
    order: DataFrame
    cut: dict | None

    def occurrences(self) -> DataFrame:
        """The mix: pass, source, id and words of each document taken, in order (`__range`, `finish`, `rank`, `pass`, `start`); words are those of the document's beginning."""
        return self.order.withColumn("taken", _given(self.cut, F.struct(*KEY), F.col("words"))).where("taken > 0")

    def documents(self) -> DataFrame:
        """queue with taken: words that the mix takes of each document over all passes."""
        each = [F.col("passes")[k] for k in range(PASSES)]
        taken = [_given(self.cut, F.struct(*(p[k].alias(k) for k in KEY)), p["words"]) for p in each]
        return self.queue.withColumn("taken", sum(taken[1:], taken[0]))


#: What tells the passes of documents with words apart, in their order, and its types.
KEY = {"finish": "double", "rank": "bigint", "pass": "int", "start": "bigint"}


def _given(cut: dict | None, key: Column, words_: Column) -> Column:
    if cut is None:
        return F.lit(0).cast("long")
    at = F.struct(*(F.lit(cut[k]).cast(t).alias(k) for k, t in KEY.items()))
    return F.when(key < at, words_).when(key == at, F.least(words_, F.lit(cut["left"]))).otherwise(F.lit(0)).cast("long")


def queued(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, size, source_size, target, weight, rank and passes: for each pass its virtual start and finish and the words due in it."""
    narrow = docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), words(docs[text_col]).alias("size"), shuffled(docs[id_col]).alias("place"))
    narrow = written(narrow, "sizes")  # texts are read once
    sources = written(narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sources")
    filled = written(targets(sources), "targets")
    small = filled.count() <= BROADCAST_ROWS
    of = filled.withColumnRenamed("source", "__source")
    rows = narrow.join(F.broadcast(of) if small else of, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    # Buckets of a source by place: their sums are few, and so are the rows of one.
    rows = rows.withColumn("bucket", F.expr(f"place div ({1 << 60} div ceil(sqrt(n)) + 1)"))
    sums = rows.groupBy("rank", "bucket").agg(F.sum("size").alias("in_bucket"))
    earlier = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("rank", "bucket", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("rank", "bucket").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(sums, ["rank", "bucket"]).withColumn("start", F.col("before") + F.sum("size").over(inside) - F.col("size"))

    def one(k: int) -> Column:
        start = F.col("start") + k * F.col("source_size")
        end = start + F.col("size")
        serving = (start < F.col("due")) & (F.col("due") < end)
        stop = F.when(serving, F.col("due")).otherwise(end)
        return F.struct((stop.cast("double") / F.col("weight")).alias("finish"), F.col("rank"), F.lit(k).alias("pass"), start.alias("start"), (stop - start).alias("words"))

    return rows.select("id", "source", "size", "source_size", "target", "weight", "rank", F.array(*(one(k) for k in range(PASSES))).alias("passes"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """The mix of all documents: see Mix."""
    queue = written(queued(docs, id_col, text_col, source_col), "queue")
    each = queue.where("size > 0").select("id", "source", F.explode("passes").alias("p")).select("id", "source", "p.*")
    order = ranged(each, [F.col(k) for k in KEY], "mix")
    total = queue.agg(F.sum("size").alias("n")).first()["n"]
    budget = (total or 0) * SHARE[0] // SHARE[1]
    # The range in which the budget ends, then the row in it.
    sums = order.groupBy("__range").agg(F.sum("words").alias("own"))
    before = offsets(order, {"before": F.col("words")})
    ends = sums.join(before, "__range").where((F.col("before") < budget) & (F.col("before") + F.col("own") >= budget)).first()
    if ends is None:
        return Mix(queue, order, None)
    inside = Window.orderBy(*KEY).rowsBetween(Window.unboundedPreceding, -1)
    rows = order.where(F.col("__range") == ends["__range"]).withColumn("before", F.lit(ends["before"]) + F.coalesce(F.sum("words").over(inside), F.lit(0)))
    last = rows.where((F.col("before") < budget) & (F.col("before") + F.col("words") >= budget)).first()
    return Mix(queue, order, {**{k: last[k] for k in KEY}, "left": budget - last["before"]})
