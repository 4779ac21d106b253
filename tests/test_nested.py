"""Nested values and long lists of a key, against plain versions."""

import json
import random
import re

from pyspark.sql import functions as F

from fieldroll.operators import listings
from fieldroll.sources import documents as docs

KEYS = ["a", "img_data", "sig", "photo_path", "b\"{}", "é,:[]"]
VALUES = ["x", "data:image/png;base64,AA", " \n DATA:;base64,", "data:no", "A" * 128, "A" * 60 + " \n" + "B" * 68 + "==", "A" * 127, "}{][,:\"\\\x01", "", "é🙂", 7, -1.5, None, True, False]


def nested(draw, depth):
    kind = draw.choice("sol" if depth else "s")
    if kind == "s":
        return draw.choice(VALUES)
    if kind == "l":
        return [nested(draw, depth - 1) for _ in range(draw.randint(0, 4))]
    return {draw.choice(KEYS): nested(draw, depth - 1) for _ in range(draw.randint(0, 4))}


def cleaned(value):
    def dropped(key, v):
        if key in docs.INLINE_FIELDS:
            return True
        if not isinstance(v, str):
            return False
        bare = "".join(v.split())
        return bool(re.match(r"(?i)\s*data:[^,]*;base64,", v)) or key == "sig" and len(bare) >= 128 and re.fullmatch("[A-Za-z0-9+/]+={0,2}", bare) is not None

    if isinstance(value, dict):
        return {k: cleaned(v) for k, v in value.items() if not dropped(k, v)}
    if isinstance(value, list):
        return [cleaned(v) for v in value if not dropped("", v)]
    return None if dropped("", value) else value


def test_without_inline_against_recursion(spark):
    draw = random.Random(5)
    values = [nested(draw, k % 13) for k in range(600)]
    rows = [(k, json.dumps(v, indent=draw.choice([None, 2]))) for k, v in enumerate(values)] + [(-1, None), (-2, "{broken"), (-3, '{"a": NaN}'), (-4, json.dumps({"a": "A" * 500_000, "sig": "A" * 500_000}))]
    got = {r.k: r.x for r in spark.createDataFrame(rows, "k int, t string").select("k", docs.without_inline(F.col("t")).alias("x")).collect()}
    for k, v in enumerate(values):
        assert json.loads(got[k]) == cleaned(v), json.dumps(v)
    assert got[-1] is None and got[-2] is None and got[-3] is None and json.loads(got[-4]) == {"a": "A" * 500_000}
    plan = spark.createDataFrame(rows[:1], "k int, t string").select(docs.without_inline(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.replace("ExistingRDD", "")


def test_without_inline_in_one_search(monkeypatch, spark):
    """No steps where values are nested a little; with them, the same where they are nested deeper. Commas go with what is left out."""
    data, sig = "data:a\"b;base64,x,y", "A" * 64 + "\n " + "/" * 63 + "="
    values = [[data, 1, data], [data, data], [1, data, data, "x"], [data], {"img_data": {"sig": [[{}]]}}, {"sig": sig, "z": {"sig": [sig], "photo_path": None}}, {data: 1, "a": "DATA:;base64,"},
        {"a": 'x"photo_path', "b": "data:,;base64,", "c": "data:base64,", "sig": sig[:-1] + "é", "y": {"sig": sig + "=="}}, data, [[], {}, {"image_data": 1.5, "k": [data, {"k": data}]}], {"signature_data": "]}", "t": "[,]"}]
    draw = random.Random(6)
    every = values + [nested(draw, k % 13) for k in range(300)]
    run = lambda own: [json.loads(r.x) for r in spark.createDataFrame(list(enumerate(map(json.dumps, own))), "k int, t string").select("k", docs.without_inline(F.col("t")).alias("x")).orderBy("k").collect()]
    monkeypatch.setattr(docs, "DEPTH", 2)
    assert run(every) == [cleaned(v) for v in every]
    monkeypatch.setattr(docs, "DEPTH", 12)
    monkeypatch.setattr(docs, "_by_steps", lambda text: F.raise_error(F.lit("steps")).cast("string"))
    assert run(values) == [cleaned(v) for v in values]


def test_canonical(spark):
    rows = spark.createDataFrame([('{"b": [1, 2.50, {"z": null, "a": "é"}], "a": true }',), ("NaN",), ("",), (None,)], "t string")
    assert [r.x for r in rows.select(docs.canonical(F.col("t")).alias("x")).collect()] == ['{"a":true,"b":[1,2.5,{"a":"é","z":null}]}', None, None, None]


def test_places_of_a_hot_key(spark):
    """Half of all rows are of one key, whose places no task finds alone."""
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 3 > 0, F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), (F.col("id") * 7919 % 4001).alias("v"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(((r.k, r.v, r.place) for r in listings.placed(rows.repartition(4), ["k"], ["v"]).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    by = {}
    for r in sorted(rows.collect(), key=lambda r: r.v):
        by.setdefault(r.k, []).append(r.v)
    assert got == sorted(((k, v, n) for k, own in by.items() for n, v in enumerate(own, 1)), key=str)


def test_first_values_and_how_many_more(spark):
    rows = spark.createDataFrame([("a", k % 7) for k in range(50)] + [("a", None), ("b", None), (None, 3), (None, 3)], "k string, v int")
    assert sorted(((r.k, r.v, r.more) for r in listings.listed(rows, ["k"], "v", 4).collect()), key=str) == sorted([("a", [0, 1, 2, 3], 3), ("b", [], 0), (None, [3], 0)], key=str)
