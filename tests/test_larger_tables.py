"""Queries on tables in which more comes together than in the small ones: against their SQL, or a plain version."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from fieldroll import catalogue
from fieldroll.functions import likeness
from fieldroll.operators import matching

from . import compare


def same(spark, folder, name, **tables):
    import duckdb

    own = duckdb.connect()
    for table, rows in tables.items():
        pq.write_table(rows, f"{folder}/{table}.parquet")
        own.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got, wanted = compare.spark_rows(catalogue.QUERIES[name](spark, str(folder))), compare.duck_rows(own, catalogue.ORACLE_SQL[name])
    assert got == wanted
    return got[1]


def test_more_revisions_of_a_day_than_the_first_own_one(spark, tmp_path):
    """Numbers that are given reach 1,000, from which those that records bring themselves go on; some rows have no value."""
    n = 2600
    value = [None if k % 500 == 7 else 98.99999995 if k % 500 == 8 else k * 37 % 1000 / 10 for k in range(n)]
    events = pa.table({"event_id": np.arange(n), "ts": pa.array([dt.datetime(2024, 1, 1 + k % 2) for k in range(n)], pa.timestamp("us")), "event_type": ["click"] * n, "value": value})
    assert len(same(spark, tmp_path, "snk01_writers_revision", events=events)) == n


def test_what_is_left_of_a_name(spark, tmp_path):
    """Two letters of a name (17067), and numbers of which nothing is left."""
    keys = [17067, 234053, 238655, 327679, 347018, 1, 2, 3]
    customer = pa.table({"c_custkey": keys, "c_mktsegment": ["HOUSEHOLD", "BUILDING", "FURNITURE", "MACHINERY"] * 2})
    same(spark, tmp_path, "str14_similarity", customer=customer)


def test_pairs_of_blocks_and_rare_characters(monkeypatch, spark):
    """Several blocks of a band; of the texts' characters only a few are told apart."""
    draw = np.random.default_rng(3)
    texts = sorted({"".join(draw.choice(list("abcdeé🙂"), draw.integers(1, 40))) for _ in range(300)})
    near = sorted({t[:k] + t[k + 1 :] for t in texts for k in (0, len(t) // 2)} - {""})
    x, y = [s for s in texts for _ in near], near * len(texts)
    wanted = {(p, q) for p, q, s in zip(x, y, likeness.ratios(x, y)) if s >= 80 - 1e-9}
    left, right = (spark.createDataFrame([(t,) for t in own], "text string") for own in (texts, near))
    monkeypatch.setattr(matching, "BLOCK", 64)
    assert [(r.a, r.b) for r in matching.similar_pairs(left, right, 80.0).orderBy("a", "b").collect()] == sorted(wanted)
    for told in (1, 3, 96):
        monkeypatch.setattr(matching, "CHARACTERS", told)
        i, j = matching.sharing_characters(texts, near, 80.0)
        assert wanted <= {(texts[p], near[q]) for p, q in zip(i, j)}
    assert [len(k) for k in matching.sharing_characters(["a"], ["b"], 80.0)] == [0, 0]


def test_texts_are_written_once_for_all_pairs(monkeypatch, spark, tmp_path):
    """Texts aren't copied for the blocks that they meet; over 64 characters, more characters than masks tell apart, a folder with signs in its name."""
    from fieldroll.sources import scratch

    draw = np.random.default_rng(5)
    signs = [chr(0x4E00 + k) for k in range(150)]
    texts = sorted({"".join(draw.choice(signs[: draw.choice([4, 150])], draw.integers(1, 110))) for _ in range(250)})
    near = sorted({t[:k] + "x" + t[k + 2 :] for t in texts for k in (0, len(t) // 2)})
    x, y = [s for s in texts for _ in near], near * len(texts)
    wanted = {(p, q) for p, q, s in zip(x, y, likeness.ratios(x, y)) if s >= 85 - 1e-9}
    left, right = (spark.createDataFrame([(t,) for t in own], "text string") for own in (texts, near))
    kept, made = [], matching.written

    def written(df, name):
        kept.append((name, out := made(df, name)))
        return out

    monkeypatch.setattr(matching, "BLOCK", 64)
    monkeypatch.setattr(matching, "written", written)
    monkeypatch.setattr(scratch, "folder", lambda spark: f"{tmp_path}/a b%20c+")
    pairs = matching.similar_pairs(left, right, 85.0)
    assert sorted((r.a, r.b) for r in pairs.collect()) == sorted(wanted) and wanted
    assert [df.count() for name, df in kept if name == "blocks"] == [len(texts), len(near)]
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan and "Generate" not in plan


def test_names_of_which_many_share_two_words(monkeypatch, spark, tmp_path):
    """Each shares two words with all others: their pairs are scored, and not kept."""
    import hashlib

    keys = [k for k in range(2_000_000) if hashlib.md5(b"%d" % k).hexdigest()[7:11] == "1234"]
    kept, made = {}, matching.written
    monkeypatch.setattr(matching, "written", lambda df, name: kept.update({name: made(df, name)}) or kept[name])
    customer = pa.table({"c_custkey": keys, "c_mktsegment": ["BUILDING"] * len(keys)})
    assert len(same(spark, tmp_path, "join05_fuzzy_top2", customer=customer)) == len(keys)
    assert kept["scored"].count() < len(keys) ** 2 / 2


def test_pairs_that_share_words(spark):
    """Texts of one to five words, of which some are frequent: all pairs that share half the words of the one with fewer, once each."""
    draw = np.random.default_rng(8)
    words = ["a", "b", "cc", "dd", "ee", *(f"w{k}" for k in range(40))]
    one, two = (sorted({" ".join(draw.choice(words, draw.integers(1, 6), p=[0.12] * 5 + [0.01] * 40)) for _ in range(150)}) for _ in range(2))
    for x, y in ((one, two), ([t for t in one if t.count(" ") == 1], [t for t in two if t.count(" ") > 1]), (two, [])):
        left, right = (spark.createDataFrame([(t,) for t in own], "text string") for own in (x, y))
        wanted = [(p, q) for p in x for q in y if 2 * len({*p.split()} & {*q.split()}) >= min(len({*p.split()}), len({*q.split()}))]
        assert sorted((r.a, r.b) for r in matching.sharing_words(left, right).collect()) == sorted(wanted)


def test_a_date_pattern_is_searched_once(spark):
    """And what no month's name stands in is no date."""
    from pyspark.sql import functions as F

    from fieldroll.functions import dates

    rows = spark.createDataFrame([("Foo 12 2200", None), ("June 12nd, 2200", "2200-06-12"), ("31 Apr 2020", None), ("29/2/2023", None), ("29/2/2024", "2024-02-29"), ("0000-01-01", None)], "t string, d string")
    found = rows.select("d", dates.any_date(F.col("t")).alias("own"))
    assert [str(r.own) for r in found.collect()] == [str(r.d) for r in rows.collect()]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") == 4


def test_a_prefix_is_neither_sorted_nor_aggregated(monkeypatch, spark):
    """Near copies, and copies of one set of shingles: one stays; nodes hold numbers alone."""
    from fieldroll.llm import simhash

    held, made = {}, simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, name: held.setdefault(name, df.columns) and made(df, name))
    words = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(words)), (2, "  ".join(words)), (3, " ".join(words[:59])), (4, "other text of six words here"), (5, None), (6, "")]
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5] and "prefix" not in held["nodes"]


def test_pages_are_cleaned_and_sorted_once(spark, sf_dir):
    """Records and warnings take one pass over a document's lines, with a dash, a day and symbols in them."""
    from fieldroll.plans.page_import import import_pages

    text = "Project No. 7\nday 3 and 2024-02-30, 2024-02-29\n\u25a0 A\n6. REMARKS\none\u00a0 two\n4. DAILY ACTIVITIES & MANPOWER BY AREA\n\u25a0 A\nActivity Today\n1. x\n\u25a0 B\n2. y\nActivity Tomorrow\n3. z"
    pages = spark.createDataFrame([(1, 1, text), (2, 1, "6. REMARKS\nRemark"), (2, 2, "more"), (3, 1, None)], "doc_id int, page int, text string")
    out = import_pages(pages, spark.createDataFrame([], "project_id string, title string, project_no string"))
    own = {r.doc_id: r for r in out["records"].collect()}
    assert (str(own[1].date), own[1].day_no, own[1].project_no, own[1].global_remarks) == ("2024-02-29", "3", "7", "one two")
    assert own[2].global_remarks == "Remark more" and 3 not in own
    assert [(r.area_id, r.kind, r.activity) for r in out["activities"].orderBy("line_no").collect()] == [("A", "today", "x"), ("B", "tomorrow", "z")]
    assert {r.code for r in out["warnings"].where("doc_id = 1").collect()} == {"date_inferred_without_label", "day_inferred_without_label"}
    for name in ("records", "warnings"):
        plan = out[name]._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("posexplode(") == 1, name
