"""Pages with void elements and left-out end tags."""

import json
import re

import numpy as np
import pytest

from fieldroll.llm import html_text


def texts(source):
    out = []

    def walk(node):
        for child in node[1]:
            out.append(child[0]) if isinstance(child, tuple) else walk(child)

    walk(html_text.parsed(source))
    return out


@pytest.mark.parametrize(
    ("source", "found"),
    [
        ("<p>one</p><embed src=x><p>two</p>", ["one", "two"]),
        ("<html><head><title>T</title><meta charset=utf-8><p>one</p><p>two</p>", ["one", "two"]),
        ("<head><title>T</title><script>var a='<div>no</div>'</script><style>p{}</style><h1>one</h1>two", ["one", "two"]),
        ("<head><script>'<p>no</p>'</script><title>T</title></head><p>one</p>", ["one"]),
        ("<head><title>T</title><article><embed src=x>one</article>", ["one"]),
        ("<head><title>T</title></head>one", ["one"]),
        ("<head><title>T</title> one <p>two", ["one", "two"]),
        ("<p>one</p><script>for(i=0;i<n;i++){x='don\"t'}</script><p>two</p>", ["one", "two"]),
        ("<p>one</p><SCRIPT type='a>b'>if(a</script2>b)</Script ><p>two</p>", ["one", "two"]),
        ("<p>one</p><script src='a>b' /><p>two</p>", ["one", "two"]),
        ("<p>one</p><script>var a='<p>no</p>", ["one"]),
        ("<p>one</p><style>a>b{content:'<c'}</style>two<noscript><img src=\"x</noscript><p>three</p>", ["one", "two", "three"]),
        ("<p>one</p><svg><svg><text>no</text></svg><text>no</text></svg><p>two</p>", ["one", "two"]),
        ("<head><svg><svg></svg>no</svg></head><p>one</p>", ["one"]),
        ("<p>one</p><a href=\"http://cut", ["one"]),
        ("<p class=it's>one</p><p title=\"a>b\">two</p>", ["one", "two"]),
        ("<!--><p>one</p><!-- <p>no</p> --!><p>two</p></ no><p>a < b</>", ["one", "two", "a < b"]),
        ("<head><title>T</title><iframe src=x></iframe><p>one</p>", ["one"]),
    ],
)
def test_texts(source, found):
    assert texts(source) == found


def test_labels_keep_what_sets_the_role():
    many = "class='col d flex hidden lg mb md p {}'"
    assert html_text.role(html_text.label_of("div", many.format("sidebar")), True) == "boiler"
    assert html_text.role(html_text.label_of("div", many.format("story")), False) == "article"
    assert html_text.label_of("div", "class='b a'") == "div.a.b"
    assert len(html_text.label_of("div", "class='" + " ".join("x" * k for k in range(1, 60)) + "'").split(".")) == 7


def test_classes_of_what_the_page_has():
    assert html_text.label_of("div", "class='page has-sidebar no-comments with_menu'") == "div.page"
    assert html_text.role(html_text.label_of("div", "class='sidebar'"), True) == "boiler"


def test_form_around_the_page():
    page = "<form id=aspnetForm><div>Menu</div><main><p>one</p><form class=search>no</form></main></form><form><p>no</p></form>"
    assert own_text([page])[0] == ["one"]


def test_end_tags_of_deep_elements():
    source = "<article><p>one</p>" + "<div>" * 150 + "deep" + "</div>" * 150 + "<p>two</p></article><footer>no</footer>"
    page = html_text.parsed(source)
    assert html_text.Wrapper(html_text.generalised(page)).blocks(page) == ["one", "deep", "two"]
    shut = html_text.parsed("<div>" * 150 + "<p>x</p>" + "</div>" * 149 + "<p>y</p>")
    assert [c for c in shut[1][0][1] if c[0] == "p"] == [["p", [("y", 0)]]]


def test_long_notice_of_every_page_is_template():
    notice = "We use what you have read here on every page alike. " * 4
    pages = [html_text.parsed(f"<div><p>{notice}</p></div><section>Text of page {k}</section>") for k in range(4)]
    tree = html_text.generalised(pages[0])
    for page in pages[1:]:
        tree = html_text.merged(tree, html_text.generalised(page))
    assert html_text.Wrapper(tree).blocks(pages[1]) == ["Text of page 1"]


def own_text(pages):
    """The main texts of pages of one host, without Spark."""
    tree = None
    for page in pages:
        new = html_text.generalised(html_text.parsed(page))
        tree = new if tree is None else html_text.merged(tree, new)
    wrapper = html_text.Wrapper(json.loads(json.dumps(tree)))
    return ["\n".join(wrapper.blocks(html_text.parsed(p))) for p in pages], tree


def test_long_flat_pages_keep_their_order():
    """A menu's paragraph before the article's isn't taken with them, however many parts the article has."""
    pages, want = [], []
    for k, parts in enumerate([2, 9, 1, 30, 14, 0]):
        own = [("h1", f"Title {k}"), *((t, f"{t} {i} of {k}") for i in range(parts) for t in ("h2", "p", "ul" if i % 3 == 1 else "p"))]
        want.append("\n".join(x for _, x in own))
        pages.append("<p>Home About Contact</p>" + "".join(f"<{t}>{x}</{t}>" for t, x in own) + "<hr><div>All rights reserved</div><pre>Site map</pre>")
    got, tree = own_text(pages)
    assert got == want
    assert len(tree[3]) <= html_text.LABELS and any(c[0] == html_text.GROUP for c in tree[3])


def test_size_of_wrappers_is_bounded():
    random_ = np.random.default_rng(5)
    tags = ["p", "h2", "ul", "pre", "table", "blockquote", "section", "dl"]
    sizes = []
    for long in (200, 4000):
        pages = ["".join(f"<{t}>{t}{k}</{t}>" for k, t in enumerate(random_.choice(tags, long))) for _ in range(4)]
        got, tree = own_text(pages)
        assert got == ["\n".join(re.findall(r">([^<]+)<", p)) for p in pages]
        sizes.append(len(json.dumps(tree)))
    assert sizes[1] < 3 * sizes[0]


def test_many_labels():
    pages = [f"<div class=page>{''.join(f'<div class=w{chr(97 + i // 26)}{chr(97 + i % 26)}>text {i} {k}</div>' for i in range(200))}</div>" for k in range(4)]
    got, tree = own_text(pages)
    assert got == ["\n".join(f"text {i} {k}" for i in range(200)) for k in range(4)]
    assert len(json.dumps(tree)) < 2000
