"""What the contracts say of odd input, against brute force where there is a result to find."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldroll.llm import decontamination, embeddings, html_text, langid, queries, secrets
from fieldroll.llm.common import new_path

from .test_html_pages import own_text

TEXT = "Words of page {} go on for a while, and then they stop."


@pytest.mark.parametrize("text", ["½ ² ① Ⅷ", "12 ٣ _ !", "", None, "🙂"])
def test_no_letter_no_language(spark, text):
    docs = spark.createDataFrame([(k, t, lang) for k in range(20) for t, lang in (("the words of it", "en"), ("die Worte davon", "de"))], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    got = langid.identify(spark.createDataFrame([(text,), ("½ the words",)], "text string"), model).collect()
    assert [r.lang_pred for r in got] == ["und", "en"] and got[0].score == 0
    assert langid.accepted(spark.createDataFrame([(text,)], "text string"), model).count() == 0


def test_secrets_beside_columns_of_their_names(spark):
    docs = spark.createDataFrame([(1, "token = abcdefgh12", "s", "b"), (2, None, None, None)], "id int, text string, Spans string, blob string")
    rows = {r.id: r for r in secrets.scanned(docs, secrets.Ledger(spark, new_path(spark, "ledger"))).collect()}
    assert [s.kind_order for s in rows[1].spans] == [0] and rows[2].spans == [] and len(rows[1].blob) == 64


def test_secrets_of_half_the_versions_then_all(spark, sf_dir):
    """A second scan reads unseen blobs only, and finds the same as one scan of all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ledger = secrets.Ledger(spark, new_path(spark, "ledger"))
    half = docs.where("doc_id % 2 = 0")
    secrets.scan(half.select("text"), ledger)
    first = ledger.rows().count()
    rows = secrets.scanned(docs, ledger).select("doc_id", secrets.joined(F.col("spans")).alias("spans"))
    assert first == half.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert ledger.rows().count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert sorted(rows.collect()) == sorted(queries.op4_secret_scans(spark, sf_dir).select("doc_id", "spans").collect())


def nearest(item, text):
    """Fewest edits of item against any stretch of text."""
    row = [0] * (len(text) + 1)
    for k, x in enumerate(item, 1):
        last, row[0] = row[0], k
        for j, y in enumerate(text, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_decontamination_against_all_places(spark):
    """Items of any size: each that has its edits or fewer in a text, and no other."""
    draw = random.Random(3)
    word = lambda: "".join(draw.choices("abcde", k=draw.randint(1, 7)))
    items = {k: " ".join(word() for _ in range(n)) for k, n in enumerate([1, 1, 1, 2, 2, 2, 3, 3, 4, 4, 5, 6, 8, 10, 14, 20] * 2)}
    texts = []
    for _ in range(60):
        parts = [" ".join(word() for _ in range(draw.randint(0, 12)))]
        for k in draw.sample(sorted(items), 2):
            own = list(items[k])
            for _ in range(draw.randint(0, decontamination.edits_of(len(own)) + 1)):
                at = draw.randrange(len(own))
                own[at : at + draw.randint(0, 1)] = draw.choice(["", "z", "zz"[:1]])
            parts += ["".join(own), word()]
        texts.append(" ".join(" ".join(parts).split()))
    texts += ["", None, "½", items[15]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([*items.items(), (98, None), (99, " !")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.edits, r.start, r.end) for r in decontamination.matches(docs, bench).collect()}
    wanted = {}
    for k, item in items.items():
        for d, text in enumerate(texts):
            text = decontamination.plain(text)
            edits = (0 if f" {item} " in f" {text} " else 99) if len(item) < decontamination.Q else nearest(item, text)
            if edits <= decontamination.edits_of(len(item)):
                wanted[d, k] = edits
    assert {pair: x[0] for pair, x in got.items()} == wanted
    for (d, k), (edits, start, end) in got.items():
        assert nearest(items[k], texts[d][start:end]) == edits and (edits or texts[d][start:end] == items[k])
    assert len({k for _, k in wanted}) > 20
    kept = {r.doc_id for r in decontamination.decontaminated(docs, bench).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in wanted}


def test_vectors_of_each_length_among_themselves(spark):
    random_ = np.random.default_rng(4)
    rows = []
    for wide in (16, 16, 24, 3):
        base = random_.standard_normal((60, wide))
        rows += [v.tolist() for v in base] + [(v + 0.05 * random_.standard_normal(wide)).tolist() for v in base[:30]]
    rows += [rows[0], [1.0], [2.0], [0.0], None, [float("nan")] * 16, rows[0] + [0.0]]
    vectors = spark.createDataFrame([(k, v, 1, "x", 2) for k, v in enumerate(rows)], "vec_id long, embedding array<double>, wide int, code string, t int")
    got = {r.vec_id: r for r in embeddings.near_duplicates(vectors).collect()}
    links = {k: set() for k in range(len(rows))}
    for a, x in enumerate(rows):
        for b, y in enumerate(rows[:a]):
            if x and y and len(x) == len(y) and np.isfinite(x).all() and np.isfinite(y).all() and any(x) and any(y):
                if np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95:
                    links[a].add(b)
                    links[b].add(a)
    found, all_ = sum(r.n_links for r in got.values()), sum(map(len, links.values()))
    assert all(got[k].n_links <= len(own) for k, own in links.items()) and found >= 0.9 * all_
    assert got[360].n_links and got[361].component_id == got[362].component_id == 361 and got[366].n_links == 0


def page(body):
    return f"<html><body><nav><a>Home</a> Menu</nav><div class=wrap>{body}</div><footer>Foot</footer></body></html>"


@pytest.mark.parametrize("copies", [1, 2, 3, 50])
def test_copies_of_a_page(copies):
    """However many copies a host has, their text is that of one."""
    alone = own_text([page(f"<h1>T</h1><p>{TEXT}</p>")])[0][0]
    assert own_text([page(f"<h1>T</h1><p>{TEXT}</p>")] * copies)[0] == [alone] * copies and alone == f"T\n{TEXT}"
    others = [page(f"<h1>T{k}</h1><p>{TEXT.format(k)}</p>") for k in range(4)]
    long = page(f"<h1>L</h1><p>{TEXT}</p><ul><li>only here</li></ul>")
    got = own_text([*others, *[long] * copies])[0]
    assert got == [f"T{k}\n{TEXT.format(k)}" for k in range(4)] + [f"L\n{TEXT}\nonly here"] * copies


def test_marks_hold_for_their_page_alone():
    marked = [page(f"<article><p>{TEXT.format(k)}</p></article>") for k in range(2)] + [page("<div class=content><p>marked by class</p></div>"), page("<article></article>")]
    plain = [page(f"<section><p>{TEXT.format(k)}</p></section>") for k in range(9, 14)]
    got = own_text([*marked, *plain])[0]
    assert got == [TEXT.format(0), TEXT.format(1), "marked by class", "", *(TEXT.format(k) for k in range(9, 14))]


@pytest.mark.parametrize(
    ("classes", "kind"),
    [
        ("post type-post category-social", "article"), ("post-12 post type-post status-publish format-standard hentry tag-newsletter category-ads", "article"),
        ("comment-body", "boiler"), ("related-post teaser promo", "boiler"), ("hentry no-sidebar has-comments", "article"),
    ],
)
def test_classes_of_posts(classes, kind):
    assert html_text.role(html_text.label_of("article", f'class="{classes}"'), False) == kind
    found = own_text([page(f'<article class="{classes}"><p>{TEXT}</p></article>')])[0][0]
    assert found == (TEXT if kind == "article" else "")


def test_tasks_change_nothing(spark, sf_dir):
    """Pages dealt over one task or many give the same texts."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    every = [sorted(tuple(r) for r in html_text.main_text(pages.repartition(n, "page_id")).collect()) for n in (1, 7)]
    assert every[0] == every[1]
