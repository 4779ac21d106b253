"""The prefix trie against its SQL and a plain version, in shards of any size."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from fieldroll.llm import prefix_tries, queries

from ..compare import connection, duck_rows, spark_rows

SCHEMA = "conv_id long, turn long, role string, text string, path string, key int, depth string"


def plain(rows):
    """The contract's rows of (conv_id, turn, role, text), by sequences as keys."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    own = {c: [(t[2], t[4]) for t in sorted(x)] for c, x in own.items()}
    members = defaultdict(list)
    path = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        head = c - int(np.fmod(c, 100))
        path[c] = tuple(own.get(head, [])[:h] + turns[h:])
        for d in range(len(path[c]) + 1):
            members[path[c][:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for key in members:
        if key:
            children[key[:-1]] += 1
    for key, of in members.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += key not in children
            saved[key[:d]] += (len(of) - 1) * len(key[-1][1]) if key else 0
    out = []
    for key, of in members.items():
        ends = ",".join(str(c) for c in sorted(of) if path[c] == key)
        out.append((min(of), len(key), min(members[key[:-1]]) if key else None, len(of), children.get(key, 0), leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_against_sql(spark, sf_dir):
    own = spark_rows(queries.op12_prefix_trie(spark, sf_dir))
    assert own == duck_rows(connection(sf_dir), queries.ORACLE_SQL["op12_prefix_trie"])


def conversations(draw, n):
    rows = []
    for c in range(n):
        for turn in range(draw.choice((0, 1, 2, 3, 7))):
            rows.append((draw.choice((c, c, c, c + 700)), draw.choice((turn, turn, None)), draw.choice(("user", "bot", None)), draw.choice(("a", "bb", "é🙂", "", None))))
    hot = [(1000 + k, t, "user", "the same") for k in range(200) for t in range(3)]
    long = [(5, t, "user", f"turn {t % 9}") for t in range(10, 400)]
    return rows + hot + long + [(-7, 1, "user", "a"), (-7, 2, "user", "b"), (None, 1, "user", "lost")] + rows[:20]


@pytest.mark.parametrize("cells", [1, 50, prefix_tries.TRIE_CELLS])
def test_against_plain(spark, cells, monkeypatch):
    rows = conversations(random.Random(7), 400)
    whole = prefix_tries.shards
    monkeypatch.setattr(prefix_tries, "shards", lambda batches: whole(batches, cells))
    turns = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(prefix_tries.prefix_trie(turns)) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_nothing(spark):
    assert prefix_tries.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    # The only conversation has fewer turns than it gives up, and its head is absent: a root without text.
    alone = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 == 5)
    rows = [(alone, None, None, None)]
    assert found(prefix_tries.prefix_trie(spark.createDataFrame([(*r, "", 0, "") for r in rows], SCHEMA))) == plain(rows)


def test_double_array():
    draw = np.random.default_rng(2)
    paths = sorted({tuple(draw.integers(0, 5, draw.integers(0, 9))) for _ in range(500)})
    units = [np.array([(bytes([65 + x]) * 16, x) for x in p], prefix_tries.UNIT) for p in paths]
    own, distinct, codes = prefix_tries.packed(units)
    seen = {}
    for p, states in zip(paths, own.states):
        for d in range(len(p) + 1):
            assert states[d] >= 0 and seen.setdefault(int(states[d]), p[:d]) == p[:d]
    assert len(seen) == sum(map(len, own.depths)) and own.trie.go(np.array([0]), np.array([len(distinct) + 1])) == -1
