"""The mix of sources against its SQL, a plain version and its own promises."""

import hashlib
import re
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from fieldroll.llm import mixing, queries, running

from ..compare import connection, duck_rows, spark_rows

SCHEMA = "doc_id long, text string, source string, rank int, size string, target int, start string"


def plain(rows):
    """doc_id, size, source_size, target, taken of (doc_id, text, source), by a queue served word for word."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    of = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in sources}
    budget, open_, target = Fraction(3 * sum(size), 2), set(sources), {}
    while open_:
        level = budget / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level >= 2 * of[s]]
        for s in full or list(open_):
            target[s] = 2 * of[s] if full else weight[s] * level
            budget -= target[s]
            open_.remove(s)
    queue = []
    for k, s in enumerate(sources):
        own = sorted((i for i, r in enumerate(rows) if r[2] == s), key=lambda i: (int(hashlib.md5(str("" if rows[i][0] is None else rows[i][0]).encode()).hexdigest()[:15], 16), rows[i][0] or 0, size[i]))
        at = 0
        for turn in range(2):
            for i in own:
                due = int(target[s])
                stop = due if at < due < at + size[i] else at + size[i]
                if size[i]:
                    queue.append((stop / weight[s], k, turn, at, stop - at, i))
                at += size[i]
    left, taken = 3 * sum(size) // 2, defaultdict(int)
    for *_, n, i in sorted(queue):
        taken[i] += min(n, left)
        left -= min(n, left)
    return sorted((str(r[0]), size[i], of[r[2]], round(float(target[r[2]]), 6), taken[i]) for i, r in enumerate(rows))


def found(df):
    return sorted((str(r.id), r.size, r.source_size, round(r.target, 6), r.taken) for r in df.collect())


def test_query_against_sql(spark, sf_dir):
    own = spark_rows(queries.op13_source_mix(spark, sf_dir))
    assert own == duck_rows(connection(sf_dir), queries.ORACLE_SQL["op13_source_mix"])
    assert own == spark_rows(queries.op13_source_mix(spark, sf_dir))


def test_odd_rows_against_plain(spark):
    texts = [None, "", "  \n\t ", "one", "a b c d e f", "é\x0b漢 🙂\x1cx", "w " * 5000, "tie tie", "tie tie"]
    rows = [(k, t, s) for s in ("b", "a", None, "Z", "é", "") for k, t in enumerate(texts, 100 * len(s or "zz"))]
    rows += [(None, "no id here", "a"), (None, "no id", "a"), (7, "again", "a"), (7, "again", "a"), (9, None, "empty source")] + [(k, "word " * (k % 7), "hot") for k in range(400)]
    docs = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA).repartition(5)
    mix = mixing.mixed(docs)
    own = mix.documents()
    assert found(own) == plain(rows)
    assert own.where("taken > 2 * size OR taken < 0").count() == 0
    total = sum(r[1] for r in plain(rows))
    assert own.agg(F.sum("taken")).first()[0] == total * 3 // 2 == mix.occurrences().agg(F.sum("taken")).first()[0]
    by_source = own.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= len(by_source) for r in by_source)


def test_order_is_fair(spark):
    """At any place of the order, sources that are not used up have given words by their weights, to within a document."""
    docs = spark.createDataFrame([(k, "w " * 10, "abc"[k % 3], 0, "", 0, "") for k in range(3000)], SCHEMA)
    given, weight = defaultdict(int), {"a": 5, "b": 2, "c": 1}
    for r in sorted(mixing.mixed(docs).occurrences().collect(), key=lambda r: (r.finish, r.rank, r["pass"], r.start)):
        given[r.source] += r.taken
        if given["a"] < 20_000:
            assert all(abs(given[s] / weight[s] - given["a"] / 5) <= 10 + 10 for s in "bc")


@pytest.mark.parametrize("text", [None, ""])
def test_nothing_to_mix(spark, text):
    none = spark.createDataFrame([], SCHEMA)
    assert mixing.mixed(none).documents().count() == 0 == mixing.mixed(none).occurrences().count()
    rows = mixing.mixed(spark.createDataFrame([(1, text, None, 0, "", 0, "")], SCHEMA)).documents().collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)]


def test_running(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), (F.col("id") % 5).alias("v"))
    own = {r.k: r.s for r in running.running(rows, [F.col("k")], {"s": F.col("v")}).collect()}
    total, wanted = 0, {}
    for r in sorted(rows.collect()):
        total += r.v
        wanted[r.k] = total
    assert own == wanted
