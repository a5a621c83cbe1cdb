"""Operator 8: main text of pages by wrapper induction.

Some pages of a host are parsed into trees and aligned by simple tree matching. Nodes whose text is the same in all of them are
template; of what varies, the container that holds nearly all running text (not links) is the content slot, whatever it is called. A page is
aligned with its host's template; what meets the slot is the article, less template text and parts that are marked as comments,
adverts or the like, which vary too. Only a host with a single page, a host whose pages hardly differ, and a page without the slot are judged by element names and marks.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lookup_join, settle, table, trimmed

#: Different pages of a host that its template is induced from: those whose html has the smallest hash. Every page is then aligned.
EXEMPLARS = 5
#: Pairs of children beyond which lists are aligned row by row in arrays, and pairs of which such a table is held at once.
WIDE, HELD = 400, 1 << 22
#: Deepest level that a tree keeps; what lies deeper hangs on that level.
DEEPEST = 400
#: Share of the text of the slot that a page has by itself below which what met the template's slot is not taken for the article.
LEAST_SHARE = 0.5
#: Share of a node's varying text that its child must hold for the slot to be sought further down.
SLOT_SHARE = 0.9
#: Share of the running text of the slot that must vary between the exemplars for them to tell template from content.
VARYING_SHARE = 0.5

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math select".split())
DROPPED = frozenset("nav footer aside form button menu dialog object canvas audio video fieldset datalist head".split()) | RAW
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
CONTAINERS = frozenset("html body div section article main center table tbody tr td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset("ul ol dl table select body html div article section main".split())
#: Words of class, id and role that mark something other than the article.
MARKS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay sidebar menu menubar nav navbar navigation breadcrumb breadcrumbs footer colophon contentinfo comment comments commentlist disqus respond replies related recommended share sharing social newsletter subscribe signup login search searchbox pagination pager skip toolbar widget complementary banner dialog form".split())
OUTSIDE_MARKS = frozenset("header masthead topbar".split())
MAIN_MARKS = frozenset("article main content post entry story".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"\shidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


sys.setrecursionlimit(max(sys.getrecursionlimit(), 50 * DEEPEST))  # trees are walked level by level


class Node:
    """An element; kids are nodes and, for text, strings. shape: equal in nodes of a tree with equal tags throughout; holds: has the slot."""

    __slots__ = ("fixed", "holds", "inner", "kids", "marks", "mass", "shape", "slot", "tag")

    def __init__(self, tag: str, marks: frozenset = frozenset()) -> None:
        self.tag, self.marks, self.kids, self.fixed, self.slot, self.mass = tag, marks, [], None, False, 0
        self.shape, self.holds, self.inner = -1, False, frozenset()

    def nodes(self) -> list[Node]:
        return [k for k in self.kids if not isinstance(k, str)]


def parse(html: str) -> Node:
    """The tree of a page; comments, declarations and raw elements leave nothing. Never fails."""
    root = Node("html")
    stack, pos, end = [root], 0, len(html)
    while pos < end:
        m = TOKEN.search(html, pos)
        text = html[pos : m.start() if m else end]
        if text:
            stack[-1].kids.append(text)
        if not m:
            break
        pos = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing, attrs = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            else:
                if tag not in INLINE:
                    stack[-1].kids.append(Node("br"))
            continue
        if tag in RAW:
            if not attrs.endswith("/") or tag in ("script", "style", "textarea", "title"):
                close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, pos)
                pos = close.end() if close else end
            continue
        if tag == "html":
            continue
        if tag not in INLINE and tag not in VOID:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag not in INLINE:
                    break
        if tag in CLOSES:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSES[tag]:
                    del stack[i:]
                    break
                if stack[i].tag in SCOPE:
                    break
        marks = frozenset(w for g in NAMES.findall(attrs) for w in re.split(r"[^a-z0-9]+", "".join(g).lower()) if w) if "=" in attrs else frozenset()
        if HIDDEN.search(attrs):
            marks |= {"popup"}
        node = Node(tag, marks)
        stack[-1].kids.append(node)
        if tag not in VOID and not attrs.endswith("/") and len(stack) < DEEPEST:
            stack.append(node)
    number(root, {})
    return root


def number(node: Node, known: dict) -> None:
    """Sets shape and holds in a subtree."""
    kids = node.nodes()
    for k in kids:
        number(k, known)
    node.holds = node.slot or any(k.holds for k in kids)
    node.shape = known.setdefault((node.tag, node.slot, tuple(k.shape for k in kids)), len(known))


def dropped(node: Node, inside: bool) -> bool:
    """Whether a node is marked as something other than the article; inside: within the article."""
    if node.tag in DROPPED or (node.tag == "header" and not inside):
        return True
    return node.tag not in ("html", "body", "main") and (bool(node.marks & MARKS) and not (node.tag == "article" and not node.marks & {"comment", "comments", "ad", "ads"}) or (not inside and bool(node.marks & OUTSIDE_MARKS)))


def _clean(pieces: list[str]) -> str:
    return " ".join(unescape("".join(pieces)).split())


def blocks(root: Node, fixed: set[int] | None = None) -> list[str]:
    """Text blocks of a subtree in page order; fixed: ids of template nodes, whose own text is left out."""
    inside = root.tag not in ("html", "body")
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if held and (text := _clean(held)):
            out.append(text)
        held.clear()

    def walk(node: Node) -> None:
        own = fixed is None or id(node) not in fixed
        for k in node.kids:
            if isinstance(k, str):
                if own:
                    held.append(k)
            elif k.tag == "br":
                held.append(" ")
            elif dropped(k, inside):
                if k.tag not in INLINE:
                    flush()
            elif k.tag in INLINE:
                walk(k)
            else:
                flush()
                walk(k)
                flush()

    walk(root)
    flush()
    return out


def own_text(node: Node) -> str:
    return _clean([k for k in node.kids if isinstance(k, str)])


def subtree(node: Node) -> Iterator[Node]:
    yield node
    for k in node.nodes():
        yield from subtree(k)


def whole_text(node: Node) -> str:
    return " ".join(t for x in subtree(node) if (t := own_text(x)))


def likeness(slot: Node, b: Node) -> float:
    """What a template's slot, which has no children, adds to its match: equal marks count as a node, and more text (Node.mass) as less than one."""
    return bool(slot.marks and slot.marks == b.marks) + b.mass / (b.mass + 1000)


def _key(a: Node, b: Node) -> tuple[int, int]:
    return a.shape, id(b) if a.holds else b.shape


def tree_match(a: Node, b: Node, memo: dict | None = None) -> float:
    """Size of the largest order-preserving match of two trees whose roots correspond (simple tree matching)."""
    if a.tag != b.tag:
        return 0
    memo = {} if memo is None else memo
    key = _key(a, b)
    if key not in memo:
        row = None
        for row, _ in _rows(a.nodes(), b.nodes(), memo):  # noqa: B007
            pass
        memo[key] = 1 + (row[-1] if row is not None else 0) + (likeness(a, b) if a.slot else 0)
    return memo[key]


def _rows(x: list[Node], y: list[Node], memo: dict) -> Iterator[tuple]:
    """For each node of x: the best sizes up to it and each of y, and what it adds with each of y. Whole lists, of any length."""
    if len(x) * len(y) <= WIDE:
        row = [0] * (len(y) + 1)
        for p in x:
            before, row, w = row, [0], [tree_match(p, q, memo) for q in y]
            for j in range(len(y)):
                row.append(max(before[j + 1], row[j], before[j] + w[j]))
            yield row, w
        return
    first: dict[int, int] = {}
    at = np.array([first.setdefault(q.shape, len(first)) for q in y])
    one = list({q.shape: q for q in y}.values())
    held: dict[int, np.ndarray] = {}
    row = np.zeros(len(y) + 1)
    for p in x:
        if p.holds:
            w = np.array([tree_match(p, q, memo) for q in y], float)
        else:
            if p.shape not in held:
                held[p.shape] = np.array([tree_match(p, q, memo) for q in one], float)
            w = held[p.shape][at]
        row = np.concatenate([[0.0], np.maximum.accumulate(np.maximum(row[1:], row[:-1] + w))])
        yield row, w


def _pairs(x: list[Node], y: list[Node], memo: dict) -> list[tuple[Node, Node]]:
    """Pairs of the best match of two lists; a table too large to hold is cut where a best match passes its middle row."""
    if not x or not y:
        return []
    if len(x) * len(y) > HELD and len(x) > 1:
        half = len(x) // 2
        for up, _ in _rows(x[:half], y, memo):  # noqa: B007
            pass
        for down, _ in _rows(x[half:][::-1], y[::-1], memo):  # noqa: B007
            pass
        cut = int(np.argmax(np.asarray(up) + np.asarray(down)[::-1]))
        return _pairs(x[:half], y[:cut], memo) + _pairs(x[half:], y[cut:], memo)
    found = list(_rows(x, y, memo))
    rows = [[0] * (len(y) + 1), *(r for r, _ in found)]
    i, j, pairs = len(x), len(y), []
    while i and j:
        w = found[i - 1][1][j - 1]
        if w and rows[i][j] == rows[i - 1][j - 1] + w:
            pairs.append((x[i - 1], y[j - 1]))
            i, j = i - 1, j - 1
        elif rows[i][j] == rows[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def align(a: Node, b: Node, memo: dict | None = None) -> Iterator[tuple[Node, Node]]:
    """Corresponding nodes of the best match."""
    memo = {} if memo is None else memo
    if not tree_match(a, b, memo):
        return
    yield a, b
    for p, q in _pairs(a.nodes(), b.nodes(), memo):
        yield from align(p, q, memo)


def find_slot(root: Node) -> Node:
    """The article of a page by itself: most text that is not marked otherwise, as deep as nearly all of that text stays in it.

    Articles and mains go first, then what is marked as content. Sets the mass of what is not marked otherwise.
    """
    size: dict[int, int] = {}
    best: list[tuple[int, int, Node]] = []

    def weigh(node: Node, inside: bool) -> int:
        kind = 3 if node.tag == "article" else 2 if node.tag == "main" or "main" in node.marks else 1 if node.marks & MAIN_MARKS and node.tag in ("div", "section") else 0
        n = len(own_text(node))
        for k in node.nodes():
            if not dropped(k, inside or kind > 0):
                n += weigh(k, inside or kind > 0)
        size[id(node)] = node.mass = n
        if kind:
            best.append((kind, n, node))
        return n

    total = weigh(root, False)
    if best and (top := max(best, key=lambda x: (x[1] > 0, x[0], x[1])))[1]:
        return top[2]
    node = root
    while True:
        kids = [k for k in node.nodes() if not dropped(k, False) and k.tag not in INLINE and k.tag != "p"]
        down = max(kids, key=lambda k: size.get(id(k), 0), default=None)
        if down is None or size.get(id(down), 0) < 0.9 * max(total, 1):
            return node
        node = down


def running(node: Node, varying: set[int], own: dict[int, int], headed: set[int], inside: bool = False, all_text: bool = False) -> int:
    """Characters of running text (outside links, not marked otherwise) in a subtree, of varying nodes or all; own: by node; headed: nodes with such a heading."""
    n = len(own_text(node)) if all_text or id(node) in varying else 0
    head = bool(n) and node.tag in HEADINGS
    for k in node.nodes():
        if k.tag != "a" and not dropped(k, inside or node.tag in ("article", "main")):
            n += running(k, varying, own, headed, inside or node.tag in ("article", "main"), all_text)
            head |= id(k) in headed or (k.tag in HEADINGS and own.get(id(k), 0) > 0)
    own[id(node)] = n
    if head:
        headed.add(id(node))
    return n


def content_slot(root: Node, varying: set[int]) -> Node:
    """The deepest container with nearly all running text that varies; a heading that varies stays in."""
    mass: dict[int, int] = {}
    headed: set[int] = set()
    running(root, varying, mass, headed)
    node = root
    while True:
        kids = node.nodes()
        down = max((k for k in kids if k.tag in CONTAINERS), key=lambda k: mass.get(id(k), 0), default=None)
        if down is None or mass.get(id(down), 0) < max(1, SLOT_SHARE * mass[id(node)]) or any(id(k) in headed for k in kids if k is not down):
            return node
        node = down


def induce(pages: list[str]) -> str | None:
    """A host's template as JSON, or None where its pages don't tell template from content: a single one, or several that hardly differ.

    A tree of [tag, text that all pages share or null, whether it is the slot, children, marks of the slot, (tag, text) of constant containers within the slot].
    """
    trees = [parse(p) for p in pages]
    n = len(trees) - 1
    if n < 1:
        return None
    pivot = trees[0]
    same: dict[int, int] = {}
    seen: dict[int, int] = {}
    for other in trees[1:]:
        for a, b in align(pivot, other):
            seen[id(a)] = seen.get(id(a), 0) + 1
            same[id(a)] = same.get(id(a), 0) + (own_text(a) == own_text(b))
    fixed = {i for i, k in same.items() if k == n}
    varying: set[int] = set()

    def grow(node: Node) -> None:
        if id(node) not in fixed:
            varying.add(id(node))
        for k in node.nodes():
            grow(k)

    grow(pivot)
    slot = content_slot(pivot, varying)
    if running(slot, varying, {}, set(), True) <= VARYING_SHARE * running(slot, varying, {}, set(), True, True):
        return None
    find_slot(pivot)  # sets masses
    slot.slot = True
    inner: set[tuple[str, str]] = set()

    def constants(node: Node) -> None:
        """Whole containers within the slot that all exemplars share; single paragraphs and words that happen to agree are content."""
        for k in node.nodes():
            text = whole_text(k)
            if k.tag in CONTAINERS and text and all(id(x) in fixed for x in subtree(k)):
                inner.add((k.tag, text))
            else:
                constants(k)

    if n > 1 and slot.tag not in ("article", "main"):
        constants(slot)

    def dump(node: Node) -> list:
        kids = [] if node.slot else [dump(k) for k in node.nodes() if id(k) in seen or k.slot]
        text = own_text(node) if id(node) in fixed and not node.slot else ""
        return [node.tag, text or None, int(node.slot), kids, sorted(node.marks) if node.slot else [], sorted(inner) if node.slot else []]

    return json.dumps(dump(pivot), ensure_ascii=False, separators=(",", ":"))


def load(raw: list) -> Node:
    def node_of(part: list) -> Node:
        node = Node(part[0], frozenset(part[4]))
        node.fixed, node.slot, node.inner = part[1], bool(part[2]), frozenset(map(tuple, part[5]))
        node.kids = [node_of(k) for k in part[3]]
        return node

    root = node_of(raw)
    number(root, {})
    return root


def extract(html: str, template: Node | None) -> str:
    """Main text of one page by its host's template; without one, or where the slot is missing or holds little, by the page's own marks."""
    tree = parse(html)
    alone = find_slot(tree)
    if template is None:
        return " ".join(blocks(alone))
    slot, fixed, inner = None, set(), frozenset()
    for a, b in align(template, tree):
        if a.slot:
            slot, inner = b, a.inner
        elif a.fixed and a.fixed == own_text(b):
            fixed.add(id(b))
    if slot is None:
        return " ".join(blocks(alone, fixed))

    def constant(node: Node) -> None:
        for k in node.nodes():
            if k.tag in CONTAINERS and (k.tag, whole_text(k)) in inner:
                fixed.update(id(x) for x in subtree(k))
            else:
                constant(k)

    if inner:
        constant(slot)
    held = lambda node: sum(map(len, blocks(node, fixed)))
    return " ".join(blocks(slot if slot is alone or held(slot) >= max(1, LEAST_SHARE * held(alone)) else alone, fixed))


def _induce_group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"host": [key[0]], "template": [induce(rows.sort_values(["order", "page_id"])["html"].tolist())]})


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Node] = {}
    for batch in batches:
        texts = []
        for html, template in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if template is not None and template not in known:
                if len(known) > 2000:
                    known.clear()
                known[template] = load(json.loads(template))
            texts.append(extract(html or "", known.get(template)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def host_of(url: F.Column) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract_pages(pages: DataFrame, exemplars: int = EXEMPLARS) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Templates come from at most `exemplars` different pages a host (a bound on fitting only), every page is aligned. Pages
    without host share the host ''. Null and empty html give empty text; broken markup is read as far as it goes. Equal pages of a
    host give equal texts, so repeated rows do. An empty table gives no rows; further columns are not read.
    """
    rows = pages.select("page_id", "url", "html").withColumn("host", host_of(F.col("url")))
    order = F.xxhash64("html")  # copies are one exemplar
    ranked = rows.filter("length(html) > 0").select("host", "page_id", order.alias("order")).groupBy("host", "order").agg(F.min("page_id").alias("page_id"))
    ranked = ranked.withColumn("nth", F.row_number().over(Window.partitionBy("host").orderBy("order", "page_id"))).filter(F.col("nth") <= exemplars)
    chosen = settle(ranked.select("host", "page_id", "order"))
    texts = lookup_join(rows.select("page_id", "html", order.alias("order")), chosen, ["page_id", "order"], "inner")
    templates = settle(texts.dropDuplicates(["host", "order"]).groupBy("host").applyInPandas(_induce_group, "host string, template string"))
    return lookup_join(rows, templates, ["host"], wide="template").select("page_id", "url", "html", "template").mapInArrow(lambda b: trimmed(_extract(b)), ", ".join(f"{c} {t}" for c, t in pages.select("page_id", "url").dtypes) + ", text string, n_chars bigint")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
