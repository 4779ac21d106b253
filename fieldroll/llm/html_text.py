"""Main text of web pages by union-free regular-expression inference.

A page is a stream of block-level tags and text. Streams of one host are aligned one after the other with the
host's wrapper: texts that differ become slots, tags that one side lacks become optional, neighbours with the
same tag become repeated groups. A long sequence is cut before each tag of its most frequent kind, and its pieces,
aligned with each other, become one repeated group between what stands before and after them; so a wrapper's
size doesn't grow with a page's length, and the order of its parts stays. Each task makes wrappers of its own pages; these, not the pages, are dealt by host
and aligned again, as a stream, first in PARTS parts of each host. So every page counts, and a host with a third of
all pages costs one small row for each task, which no single task reads all of.

The wrapper tells which of its text slots belong to the article: those inside an article or main element, or
such a class, outside menus, headers, footers, sidebars, notices, adverts, forms and comments. Each page is
then matched with its host's wrapper, and its texts in article slots are the main text; a page without such an
element gives its texts in slots outside such boilerplate that differ between pages and aren't lists of links,
or, where nothing differs, in all of these. Pages of the same content count once there.

Defined results: null and empty html give an empty text; cut-off pages are closed at their end, and a tag, comment or
script that never ends goes up to it; in scripts and other raw text nothing is a tag but the end tag; a url that is
null or has no host shares the wrapper of such pages; repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, written

#: Wrappers of at most this many bytes in all are broadcast; beyond, pages are joined with them by host.
BROADCAST_BYTES = 32 << 20
#: Tasks over which the wrappers of one host are dealt before the last alignment.
PARTS = 64
#: In longer sequences of children repeated groups are looked for.
SEQUENCE = 12
#: Sequences that have more different labels become a repeated group of optionals, without order.
LABELS = 64
#: Deeper elements have no node of their own: their texts count as those of the element at this depth.
DEPTH = 100
#: A text that this many different pages of a host share, and none varies, is part of the template; copies count once.
TEMPLATE_PAGES = 3
#: Of longer texts wrappers hold a digest.
CONSTANT = 120

#: Element names.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN = frozenset("head script style noscript template svg math iframe object embed canvas audio video select textarea button option datalist title".split())
#: Elements that a head may hold; any other ends it.
HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
#: Hidden elements that may hold others of their name.
NESTING = frozenset("svg math object template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",), "option": ("select",)}
#: Names of elements, and words in class and id, of boilerplate and of the article.
BOILER_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
BOILER_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login signin register sidebar side widget widgets related recommended trending popular menu navbar nav navigation breadcrumb breadcrumbs pagination pager toolbar topbar masthead footer foot copyright legal disclaimer comment comments commentlist reply replies respond disqus discussion share sharing social follow tags taglist skip search searchbox form".split())
ARTICLE_TAGS = frozenset("article main".split())
ARTICLE_WORDS = frozenset("article articlebody post postbody entry story content maincontent main".split())

#: Attributes up to the tag's end, where only a quote after = begins a quoted value; a page may be cut off in one.
_ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?)*+"""
_token = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)"
    # Elements of raw text, whose content has no tags, as a whole.
    rf"|(?i:<(script|style|title|textarea|iframe|noscript|noembed|noframes)(?=[\s/>]){_ATTRIBUTES}(?<!/)>.*?(?:</\1(?=[\s/>])[^>]*(?:>|\Z)|\Z))"
    rf"|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})(?:>|\Z)|([^<]+|<)",
    re.S,
)
#: Classes that tell what the page has or lacks, not what the element is.
_qualified = re.compile(r"(?<![\w-])(?:has|with|no|without)[-_]\S*", re.I)
#: Classes of a post's kind and subjects, as blogs write them.
_post = re.compile(r"(?<![\w-])(?:hentry|post-\d+|type-post)(?![\w-])", re.I)
_subjects = re.compile(r"(?<![\w-])(?:category|tag|cat|topic|term|type|format|status)[-_]\S*", re.I)
_naming = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_word = re.compile(r"[A-Za-z]+")


def label_of(name: str, attributes: str) -> str:
    """Element name with the words of its class, id and role: all of the boilerplate's and the article's, and of others six of 24 letters at most."""
    if "=" not in attributes:
        return name
    values = [_qualified.sub("", m[1] or m[2] or m[3] or "") for m in _naming.finditer(attributes)]
    if name in ARTICLE_TAGS or any(map(_post.search, values)):
        values = [_subjects.sub("", v) for v in values]
    words = {w.lower() for v in values for w in _word.findall(v)}
    if len(words) > 6 or any(len(w) > 24 for w in words):
        known = words & (BOILER_WORDS | ARTICLE_WORDS)
        words = known.union(sorted(w for w in words - known if len(w) <= 24)[:6])
    return name + "".join(f".{w}" for w in sorted(words)) if words else name


def parsed(source: str) -> list:
    """A tree [label, children]; a text is (text, characters inside links)."""
    root = ["#root", []]
    stack, names = [root], ["#root"]  # names goes on where stack ends at DEPTH
    opened = Counter(names)
    pieces: list[str] = []
    link, linked, hidden, within, nested = 0, 0, None, None, 0

    def settle() -> None:
        nonlocal linked
        if pieces:
            raw = "".join(pieces)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                stack[-1][1].append((text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def close(to: int) -> None:
        settle()
        opened.subtract(names[to:])
        del stack[to:], names[to:]

    for m in _token.finditer(source):
        raw, slash, name, attributes, text = m.groups()
        if text is not None:
            if hidden == "head" and text.strip():
                hidden = None
            if hidden is None:
                pieces.append(text)
                if link:
                    linked += len(text)
            continue
        if name is None:
            if raw and hidden == "head" and raw.lower() not in HEAD:
                hidden = None
            continue
        name = name.lower()
        if hidden is not None:
            if "head" in (hidden, within) and (slash and name == "head" or not slash and name == "body"):
                hidden, within, nested = None, None, 0
            elif slash:
                if name == hidden and nested:
                    nested -= 1
                elif name == hidden:
                    hidden, within = within, None
            elif hidden == "head":
                if name not in HEAD:
                    hidden = None
                elif name in HIDDEN and name != "head" and not attributes.endswith("/"):
                    hidden, within = name, "head"
            elif name == hidden and name in NESTING and not attributes.endswith("/"):
                nested += 1
            if hidden is not None or slash:
                continue
        if name in HIDDEN and name not in VOID:
            if not slash and not attributes.endswith("/"):
                hidden = name
            continue
        if name in INLINE:
            if name == "a":
                link = 0 if slash else 1
            elif name in ("br", "img", "wbr"):
                pieces.append(" ")
            continue
        if slash:
            if opened[name]:
                close(next(k for k in range(len(names) - 1, 0, -1) if names[k] == name))
            continue
        settle()
        if name in ("html", "body") or name in VOID:
            continue
        if name in CLOSES_P and names[-1] == "p":
            close(len(names) - 1)
        elif name in SIBLINGS:
            for k in range(len(names) - 1, 0, -1):
                if names[k] == name or name in ("dt", "dd") and names[k] in ("dt", "dd") or name in ("td", "th") and names[k] in ("td", "th"):
                    close(k)
                    break
                if names[k] in SIBLINGS[name]:
                    break
        if len(names) < DEPTH:
            node = [label_of(name, attributes), []]
            stack[-1][1].append(node)
            stack.append(node)
        names.append(name)
        opened[name] += 1
    settle()
    return root


# A wrapper's node: [label, optional, repeated, children, bag] for an element, where bag marks a repeated group of
# optionals; the same with the label GROUP for a repeated group of several elements; ["#", optional, repeated, constant
# or None, characters, characters in links, numbers of TEMPLATE_PAGES different pages at most] for a text.
GROUP = "("


def constant(text: str) -> str:
    """The text, or a digest of a long one."""
    return text if len(text) <= CONSTANT else "\0" + hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def generalised(node: list, page: int | None = None) -> list:
    """The wrapper of one page; page: a number of its content, the same for its copies."""
    if page is None:
        page = int.from_bytes(hashlib.blake2b(repr(node).encode("utf-8", "surrogatepass"), digest_size=5).digest(), "big")
    children: list = []
    for child in node[1]:
        if isinstance(child, tuple):
            text, linked = child
            new = ["#", False, False, constant(text), len(text), linked, [page]]
        else:
            new = generalised(child, page)
        if children and children[-1][0] == new[0]:
            children[-1] = merged(children[-1], new)
            children[-1][2] = True
        else:
            children.append(new)
    return bounded([node[0], False, False, children, False])


def merged(a: list, b: list) -> list:
    """Two wrapper nodes with the same label as one."""
    if a[0] == "#":
        pages = sorted({*a[6], *b[6]})[:TEMPLATE_PAGES]
        return ["#", a[1] or b[1], a[2] or b[2], a[3] if a[3] == b[3] else None, a[4] + b[4], a[5] + b[5], pages]
    out = [a[0], a[1] or b[1], a[2] or b[2], [], a[4] or b[4]]
    if out[4]:
        out[3] = a[3] + b[3]
        return as_bag(out)
    if [x[0] for x in a[3]] == [x[0] for x in b[3]]:
        out[3] = [merged(x, y) for x, y in zip(a[3], b[3])]
        return out
    out[3] = aligned(a[3], b[3])
    return bounded(out)


def aligned(a: list, b: list) -> list:
    """Children in common order; what one side lacks is optional, neighbours of the same label are one repeated node."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(table[i + 1][j], table[i][j + 1])
    out: list = []

    def put(node: list, optional: bool) -> None:
        if optional:
            node = [node[0], True, *node[2:]]
        if out and out[-1][0] == node[0]:
            both = merged(out[-1], node)
            both[1], both[2] = out[-1][1] and node[1], True
            out[-1] = both
        else:
            out.append(node)

    i = j = 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i][0] == b[j][0]:
            put(merged(a[i], b[j]), False)
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and table[i + 1][j] >= table[i][j + 1]:
            put(a[i], True)
            i += 1
        else:
            put(b[j], True)
            j += 1
    return out


def bounded(node: list) -> list:
    if len(node[3]) > SEQUENCE:
        node[3] = grouped(node[3])
        if len(node[3]) > LABELS:
            return as_bag(node)
    return node


def grouped(children: list) -> list:
    """A long sequence with its repeated part as a group, again until it is short or no label comes twice.

    The part goes from the first to the last child of the most frequent label, and on as long as labels follow that are in
    the pieces before.
    """
    while len(children) > SEQUENCE:
        label, times = Counter(c[0] for c in children).most_common(1)[0]
        if times == 1:
            break
        starts = [k for k, c in enumerate(children) if c[0] == label]
        known = {c[0] for c in children[starts[0] : starts[-1]]}
        end = starts[-1] + 1
        while end < len(children) and children[end][0] in known:
            end += 1
        pieces = [children[a:b] for a, b in zip(starts, [*starts[1:], end])]
        piece = pieces[0]
        for other in pieces[1:]:
            piece = aligned(piece, other) if [x[0] for x in piece] != [x[0] for x in other] else [merged(x, y) for x, y in zip(piece, other)]
        if len(piece) == 1:
            piece[0][2] = True
            children = [*children[: starts[0]], *piece, *children[end:]]
        else:
            children = [*children[: starts[0]], [GROUP, False, True, grouped(piece), False], *children[end:]]
    return children


def as_bag(node: list) -> list:
    """The children as a repeated group of optionals, one for each label."""
    by: dict[str, list] = {}
    for child in node[3]:
        by[child[0]] = merged(by[child[0]], child) if child[0] in by else list(child)
    if len(by) > LABELS:
        wide = list(by.values())
        by = {}
        for child in wide:
            label = role_label(child[0])
            child = [label, *child[1:]]
            by[label] = merged(by[label], child) if label in by else child
    for child in by.values():
        child[1] = child[2] = True
    return [node[0], node[1], node[2], list(by.values()), True]


def role_label(label: str) -> str:
    name, *words = label.split(".")
    return ".".join([name, *(w for w in words if w in BOILER_WORDS or w in ARTICLE_WORDS)])


def role(label: str, inside: bool) -> str:
    """boiler, article or nothing, for an element inside an article or not."""
    name, *words = label.split(".")
    if name in BOILER_TAGS or name == "header" and not inside:
        return "boiler"
    if name in ARTICLE_TAGS:
        return "article" if not any(w in BOILER_WORDS for w in words) else "boiler"
    if any(w in BOILER_WORDS for w in words):
        return "boiler"
    return "article" if any(w in ARTICLE_WORDS for w in words) else ""


def around_article(node: list) -> bool:
    """Whether a form holds an article or main element, as where one form is around the whole page."""
    name, *words = node[0].split(".")
    return name == "form" and not any(w in BOILER_WORDS for w in words) and holds_article(node)


def holds_article(node: list) -> bool:
    return any(c[0] != "#" and (c[0].split(".")[0] in ARTICLE_TAGS and role(c[0], False) == "article" or role(c[0], False) != "boiler" and holds_article(c)) for c in node[3])


class Wrapper:
    """A host's wrapper with its article slots."""

    def __init__(self, tree: list | None):
        self.tree = tree
        self.articles: set[int] = set()  # elements that mark a page's article
        self.inside: set[int] = set()  # slots within them
        self.varied: set[int] = set()  # other slots outside boilerplate and the template
        self.plain: set[int] = set()  # the same with the template
        self.flat: dict[int, tuple[list, list]] = {}
        if tree is not None:
            self.sort(tree, False)

    def sort(self, node: list, within: bool) -> None:
        for child in node[3]:
            if child[0] == "#":
                if within:
                    self.inside.add(id(child))
                elif child[5] <= 0.6 * child[4]:
                    self.plain.add(id(child))
                    if child[3] is None or len(child[6]) < TEMPLATE_PAGES:
                        self.varied.add(id(child))
            elif (kind := role(child[0], within)) != "boiler" or around_article(child):
                if kind == "article":
                    self.articles.add(id(child))
                self.sort(child, within or kind == "article")

    def blocks(self, page: list) -> list[str]:
        """The page's texts in its article's slots; of a page without such, those that vary, or else all outside boilerplate."""
        found: list[tuple[str, int]] = []
        if self.tree is None:
            return []
        if self.walk(page, self.tree, found):
            return [text for text, slot in found if slot in self.inside]
        return [text for text, slot in found if slot in self.varied] or [text for text, slot in found if slot in self.plain]

    def places(self, own: list) -> tuple[list, list]:
        """The node's children, those of groups in their place, and the ranges of the groups around each, inner ones first."""
        if id(own) not in self.flat:
            children: list = []
            around: list = []

            def visit(nodes: list, groups: list) -> None:
                for node in nodes:
                    if node[0] == GROUP:
                        inner = [len(children), 0]
                        visit(node[3], [inner, *groups])
                        inner[1] = len(children)
                    else:
                        children.append(node)
                        around.append(groups)

            whole = [0, 0]
            visit(own[3], [whole])
            whole[1] = len(children)
            self.flat[id(own)] = children, around
        return self.flat[id(own)]

    def walk(self, node: list, own: list, out: list[tuple[str, int]]) -> bool:
        """Adds the node's texts with their slots; whether it holds an element that marks an article."""
        children, around = self.places(own)
        at, marked = 0, False
        for child in node[1] if children else ():
            label = "#" if isinstance(child, tuple) else child[0]
            for first, end in around[at]:  # on in the group, again from its start, then outside
                found = next((k for k in chain(range(at, end), range(first, at)) if children[k][0] == label), None)
                if found is not None:
                    break
            else:
                wide = role_label(label)
                found = next((k for k, c in enumerate(children) if c[0] == wide), None)
                if found is None:
                    continue
            at = found
            if label != "#":
                inner = self.walk(child, children[found], out)
                marked = marked or inner or id(children[found]) in self.articles
            else:
                out.append((child[0], id(children[found])))
        return marked


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON), from pages of host and html."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tree = generalised(parsed(source or ""))
                held[host] = merged(held[host], tree) if host in held else tree
                if len(held) >= 5000:
                    yield packed(held)
                    held = {}
        if held:
            yield packed(held)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree = None, None
        for batch in batches:
            for host, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if host != now:
                    if tree is not None:
                        yield packed({now: tree})
                    now, tree = host, json.loads(part)
                else:
                    tree = merged(tree, json.loads(part))
        if tree is not None:
            yield packed({now: tree})

    kind = "host string, wrapper string"
    parts = pages.mapInArrow(partial, kind).withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(PARTS)))
    parts = parts.repartition("host", "part").sortWithinPartitions("host", "part", "wrapper").select("host", "wrapper").mapInArrow(whole, kind)
    return parts.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(whole, kind)


def packed(trees: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"host": list(trees), "wrapper": [json.dumps(t) for t in trees.values()]}, pa.schema([("host", pa.string()), ("wrapper", pa.string())]))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars for every page."""
    spark = pages.sparkSession
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    found = written(wrappers(rows.select("host", "html")), "wrappers")
    size = found.agg(F.coalesce(F.sum(F.octet_length("wrapper") + F.octet_length("host")), F.lit(0)).alias("n")).first()["n"]
    schema = f"id {rows.schema['id'].dataType.simpleString()}, url {rows.schema['url'].dataType.simpleString()}, text string, n_chars long"
    if size <= BROADCAST_BYTES:
        shared = spark.sparkContext.broadcast({r["host"]: r["wrapper"] for r in found.toLocalIterator()})
        return map_batches(rows, _extractor(shared), schema).withColumnRenamed("id", id_col)
    joined = rows.join(found, "host", "left").select("id", "url", "html", "host", "wrapper")
    return map_batches(joined, _extractor(None), schema).withColumnRenamed("id", id_col)


_own: dict[str, tuple[str, Wrapper]] = {}


def _wrapper(host: str, source: str | None) -> Wrapper:
    if host not in _own or _own[host][0] != source:
        if len(_own) >= 5000:
            _own.clear()
        _own[host] = (source, Wrapper(json.loads(source) if source else None))
    return _own[host][1]


def _extractor(shared):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sources, hosts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        own = batch.column(4).to_pylist() if shared is None else map(shared.value.get, hosts)
        texts = ["\n".join(_wrapper(h, w).blocks(parsed(s or ""))) for s, h, w in zip(sources, hosts, own)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    return run
