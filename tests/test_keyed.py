"""Keyed tables: versions, writers at once, failures, streams that start again."""

import threading

import pytest
from pyspark.sql import functions as F

from fieldroll.sources.keyed import AlreadyExists, KeyedTable
from fieldroll.streaming.revisions import upsert_stream

SCHEMA = "k long, v string, n long"


@pytest.fixture
def store(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], buckets=4)


def rows(spark, *of):
    return spark.createDataFrame(list(of), SCHEMA)


def content(df):
    return sorted(tuple(r) for r in df.collect())


def test_changes(spark, store):
    assert content(store.read()) == [] and store.manifest()["version"] == 0
    assert store.upsert(rows(spark, (1, "a", 1), (2, "b", 5), (1, "c", 3)), ["n"]) == 1
    store.upsert(rows(spark, (2, "late", 4), (3, "d", 1), (None, "none", 1)), ["n"])
    assert content(store.read().where("k is not null")) == [(1, "c", 3), (2, "b", 5), (3, "d", 1)]
    store.insert_absent(rows(spark, (1, "no", 9), (4, "z", 2), (4, "y", 1)), ["n"])
    store.delete(rows(spark, (3, "", 0), (3, "", 0), (9, "", 0)))
    assert content(store.read().where("k is not null")) == [(1, "c", 3), (2, "b", 5), (4, "y", 1)]
    assert content(store.read(1)) == [(1, "c", 3), (2, "b", 5)]
    store.upsert(rows(spark, (1, "x", 0)).limit(0), ["n"])
    assert store.read().count() == 4


def test_only_touched_buckets_are_written(spark, store):
    store.upsert(spark.range(100).select(F.col("id").alias("k"), F.lit("a").alias("v"), F.lit(1).cast("long").alias("n")), ["n"])
    before = store.manifest()["files"]
    store.upsert(rows(spark, (7, "b", 2)), ["n"])
    after = store.manifest()["files"]
    assert len(before) == 4 and sum(before[b] != after[b] for b in before) == 1


def files_of(path):
    return len(list(path.rglob("part-*.parquet")))


def test_files_stay_few(spark, store, tmp_path):
    wanted = {}
    for k in range(30):
        store.upsert(rows(spark, (k % 7, f"v{k}", k)), ["n"])
        wanted[k % 7] = f"v{k}"
    assert {r.k: r.v for r in store.read().collect()} == wanted
    assert store.vacuum(keep=2, grace_seconds=3600) == 0 and store.vacuum(keep=2, grace_seconds=0) > 20
    assert files_of(tmp_path / "t") <= 2 * 4 and {r.k: r.v for r in store.read().collect()} == wanted
    store.delete(rows(spark, (0, "", 0)))
    store.vacuum(keep=1, grace_seconds=0)
    assert spark.read.parquet(*map(str, (tmp_path / "t").glob("data-*/__bucket=*"))).where("k = 0").count() == 0


def at_once(*jobs):
    failed = []

    def run(job):
        try:
            job()
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    threads = [threading.Thread(target=run, args=(j,)) for j in jobs]
    [t.start() for t in threads]
    [t.join() for t in threads]
    return failed


def test_writers_at_once(spark, store, tmp_path):
    """Two of the same key get numbers 1 and 2; those of other keys don't disturb each other."""
    other = lambda: KeyedTable(spark, store.path, SCHEMA, ["k"], buckets=4)
    jobs = [lambda k=k, v=v: other().archive(rows(spark, (k, v, None)), "n", ["v"]) for k, v in ((1, "a"), (1, "b"), (2, "c"), (3, "d"), (1, "e"))]
    assert at_once(*jobs) == []
    found = content(store.read())
    assert [(k, n) for k, _, n in sorted(found, key=lambda r: (r[0], r[2]))] == [(1, 1), (1, 2), (1, 3), (2, 1), (3, 1)] and {v for _, v, _ in found} == set("abcde")
    assert store.manifest()["version"] == 5


def test_given_numbers(spark, store):
    store.archive(rows(spark, (1, "a", 7), (1, "b", None), (1, "c", None)), "n", ["v"])
    assert content(store.read()) == [(1, "a", 7), (1, "b", 8), (1, "c", 9)]
    with pytest.raises(AlreadyExists):
        store.archive(rows(spark, (1, "again", 7)), "n", ["v"])
    failed = at_once(*(lambda: store.archive(rows(spark, (5, "x", 1)), "n", ["v"]) for _ in range(3)))
    assert len(failed) == 2 and all(isinstance(e, AlreadyExists) for e in failed)
    assert content(store.read().where("k = 5")) == [(5, "x", 1)]


def test_a_writer_that_dies_leaves_nothing(spark, store, monkeypatch):
    store.upsert(rows(spark, (1, "a", 1)), ["n"])

    def dies(self, manifest):
        raise KeyboardInterrupt

    monkeypatch.setattr(KeyedTable, "_created", dies)
    with pytest.raises(KeyboardInterrupt):
        store.upsert(rows(spark, (1, "b", 2), (2, "c", 1)), ["n"])
    monkeypatch.undo()
    assert content(store.read()) == [(1, "a", 1)]
    store.upsert(rows(spark, (1, "d", 3)), ["n"])
    assert content(store.read()) == [(1, "d", 3)]


def test_a_batch_counts_once(spark, store, tmp_path):
    assert store.upsert(rows(spark, (1, "a", 1)), ["n"], batch=("s", 0)) == store.upsert(rows(spark, (1, "b", 2)), ["n"], batch=("s", 0)) == 1
    source = tmp_path / "source"
    for part in ([(1, "c", 3), (2, "x", 9)], [(1, "d", 2), (2, "y", 10)]):
        rows(spark, *part).write.mode("append").parquet(str(source))
        upsert_stream(spark.readStream.schema(SCHEMA).parquet(str(source)), store, ["n"], str(tmp_path / "offsets")).awaitTermination()
    assert content(store.read()) == [(1, "c", 3), (2, "y", 10)]


def test_contents_of_assets_are_set_down_once(monkeypatch, spark, tmp_path):
    """Beside the store itself a write holds each content in one table; copies and contents of an earlier write add none."""
    from fieldroll.sources import keyed, sinks

    held, made = [], keyed.written
    for module in (keyed, sinks):
        monkeypatch.setattr(module, "written", lambda df, name: held.append("content" in df.columns) or made(df, name), raising=False)
    store = sinks.AssetStore(spark, str(tmp_path / "assets"))
    for rows in ([(b"a", "x"), (b"a", "y"), (None, "x")], [(b"a", "z"), (b"b", "x"), (b"", "x")]):
        store.add(spark.createDataFrame(rows, "content binary, owner string"), "owner")
    assert held == [True, False] * 2
    assert sorted(bytes(r.content) for r in store.contents().collect()) == [b"", b"a", b"b"] and store.index().count() == 5
