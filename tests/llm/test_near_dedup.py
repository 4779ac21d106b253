"""The pipeline's near_dedup against the Jaccard similarity of all pairs."""

import numpy as np

from fieldroll.llm import buckets, simhash

from .test_operators import brute_components


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def test_pairs_are_linked_by_jaccard(spark):
    random_ = np.random.default_rng(3)
    texts = []
    for edits in [2, 3, 4, 5, 6, 7, 8, 9, 10] * 12:
        words = [f"w{k}" for k in random_.integers(0, 5000, 300)]
        texts.append(" ".join(words))
        for k in random_.choice(300, edits, replace=False):
            words[k] = "other"
        texts.append(" ".join(words))
    passage = " ".join(f"p{k}" for k in range(60))  # frequent shingles: last in the order
    for edits in [4, 8, 12] * 20:
        words = [f"w{k}" for k in random_.integers(0, 5000, 100)] + [passage] + [f"w{k}" for k in random_.integers(0, 5000, 100)]
        texts.append(" ".join(words))
        for k in random_.choice(100, edits, replace=False):
            words[k] = f"new{k}"
        texts.append(" ".join(words))
    texts += ["a b c d e f g h", "a b c d e f g h i", "A b  c d e f g h", "short", "", None]
    own = dict(enumerate(map(shingles, texts)))
    label = brute_components(list(own), lambda a, b: 10 * len(own[a] & own[b]) >= 8 * len(own[a] | own[b]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.deduplicated(docs).collect()} == {k for k in own if label[k] == k}


def test_one_id_of_two_groups(spark):
    rows = [(1, "one two three four five six"), (1, "seven eight nine ten eleven twelve"), (2, "seven eight nine ten eleven twelve"), (2, "one two three four five six")]
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept)) == sorted(rows[:2])


def test_order_of_shingles():
    values, last = np.array([2, 3, 5, 7, 11], np.uint64), np.array([5, 3, 4], np.uint64)  # rarer ones first
    rank = np.argsort(last, kind="stable")
    assert simhash.ordered(values, last[rank], rank).tolist() == [2, 7, 11, 5, 3]
    assert simhash.ordered(values, last[:0], rank[:0]).tolist() == values.tolist()


def test_frequent_shingles(spark):
    docs = spark.createDataFrame([(k, f"a b c d e own{k} x y z u v") for k in range(40)] + [(50, None), (51, "")], "doc_id long, text string")
    found = simhash.frequent_shingles(docs, "text", 5, most=2)
    assert set(found.tolist()) == set(simhash.shingle_set("a b c d e", 5)[0].tolist() + simhash.shingle_set("x y z u v", 5)[0].tolist())
    assert len(simhash.frequent_shingles(docs.where("doc_id < 0"), "text", 5)) == 0


def test_group_of_loosely_similar_texts(spark):
    """Copies of one text with edits of their own: most pairs are below the bound, and few of them are compared in full."""
    random_ = np.random.default_rng(8)
    base = [f"w{k}" for k in random_.integers(0, 5000, 150)]
    texts = []
    for k in range(300):
        words = list(base)
        for at in random_.choice(150, random_.integers(1, 9), replace=False):
            words[at] = f"e{k}x{at}"
        texts.append(" ".join(words))
    own = dict(enumerate(map(shingles, texts)))
    label = brute_components(list(own), lambda a, b: 10 * len(own[a] & own[b]) >= 8 * len(own[a] | own[b]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.deduplicated(docs).collect()} == {k for k in own if label[k] == k}


def loose_group(n):
    """n texts with 1 to 8 edits of one base: some pairs are similar, most of the others nearly so."""
    random_ = np.random.default_rng(8)
    base = [f"w{k}" for k in random_.integers(0, 5000, 150)]
    texts = []
    for k in range(n):
        words = list(base)
        for at in random_.choice(150, random_.integers(1, 9), replace=False):
            words[at] = f"e{k}x{at}"
        texts.append(" ".join(words))
    return texts


def test_pairs_of_a_large_loose_group_stay_in_their_task(spark, monkeypatch):
    """No step makes more pairs than it reads rows, and a class of which parts stay apart is still joined as all pairs do."""
    texts = loose_group(300)
    made, inner = [], simhash.map_groups

    def counted(rows, group, run, schema, *more):
        out = inner(rows, group, run, schema, *more)
        if schema.startswith("a long"):
            made.append((out.count(), rows.count()))
        return out

    monkeypatch.setattr(simhash, "map_groups", counted)
    own = dict(enumerate(map(shingles, texts)))
    label = brute_components(list(own), lambda a, b: 10 * len(own[a] & own[b]) >= 8 * len(own[a] | own[b]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.deduplicated(docs).collect()} == {k for k in own if label[k] == k}
    assert len(made) == 3 and all(pairs <= rows for pairs, rows in made), made


def test_classes_in_chunks(spark):
    """Chunks of any size give the same components; pairs below the similarity and other classes are not linked."""
    texts = loose_group(90)
    of = {k: k // 60 for k in range(90)}  # two classes, in which no component is known
    rows, full = [], []
    for k, (values, wide) in enumerate(simhash.shingle_set(t, 5) for t in texts):
        bits = np.unpackbits(wide, axis=1, bitorder="little").sum(0, dtype=np.int64)
        fp, more = (int(x) for x in np.packbits(2 * bits > len(wide), bitorder="little").view(np.int64))
        rows.append((k, of[k], k, len(values), fp, more))
        full.append((k, values.tobytes(), simhash.bitmap(values)))
    rows = spark.createDataFrame(rows, "node long, loose long, component long, size int, fp long, more long")
    full = spark.createDataFrame(full, "node long, set binary, map binary")
    own = [*map(shingles, texts)]
    similar = lambda a, b: of[a] == of[b] and 10 * len(own[a] & own[b]) >= 8 * len(own[a] | own[b])
    label = brute_components(list(of), similar)
    assert len({label[k] for k in of}) < 90
    for chunk in (4, 2048):
        pairs = [(r.a, r.b) for r in simhash.similar_within(rows, full, 0.8, 20, chunk).collect()]
        assert all(similar(a, b) for a, b in pairs)
        found = brute_components(list(of), lambda a, b: a == b or (a, b) in pairs or (b, a) in pairs)
        assert found == label


def test_spanning_links():
    random_ = np.random.default_rng(1)
    a, b = random_.integers(0, 200, (2, 150))
    forest = buckets.Forest(200)
    x, y = forest.link(a, b)
    again = buckets.Forest(200)
    again.link(x, y)
    assert np.array_equal(forest.label, again.label) and len(x) == 200 - len(set(forest.label.tolist()))
    assert set(zip(x.tolist(), y.tolist())) <= set(zip(a.tolist(), b.tolist()))


def test_bitmaps_bound_the_overlap():
    random_ = np.random.default_rng(4)
    for size in (3, 100, 3000):
        one = random_.integers(0, 1 << 62, size).astype(np.uint64)
        two = np.unique(np.concatenate([one[: 2 * size // 3], random_.integers(0, 1 << 62, size // 2).astype(np.uint64)]))
        one = np.unique(one)
        x, y = (np.frombuffer(simhash.bitmap(s), np.uint64) for s in (one, two))
        both = len(np.intersect1d(one, two))
        assert both <= min(len(one) - int(np.bitwise_count(x & ~y).sum()), len(two) - int(np.bitwise_count(y & ~x).sum()))
