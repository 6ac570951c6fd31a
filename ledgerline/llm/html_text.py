"""Operator 9: main text by a tree-structured graphical model of the page.

Block elements and runs of inline text are the nodes of a tree, each content or not. A
node has a potential from its own features, and each parent and child share a potential
that favours equal labels by a weight that depends on the edge's sort. Sum-product messages, passed up from the leaves
and down from the root, give the exact marginal of every node, and with them the exact
gradient by which the weights are trained on labelled pages. Text runs whose marginal is
over one half are the main text.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts_of
from .html_training import labelled_page

#: Pages that the model is fitted on, and the steps of that fit.
TRAINING_PAGES, STEPS = 800, 200

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

#: Sorts of HTML elements.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "annotation", "annotation-xml"}
SKIPPED = {"svg", "select", "button", "object", "canvas", "audio", "video", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
    "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
    "time", "tt", "u", "var",
    "math", "menclose", "merror", "mfrac", "mi", "mmultiscripts", "mn", "mo", "mover", "mpadded", "mphantom", "mprescripts",
    "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable", "mtd", "mtext", "mtr", "munder",
    "munderover", "semantics",
}
TEXT_BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "dt", "dd", "td", "th", "figcaption"}
NESTED = {"svg", "object", "audio", "video", "canvas"}
#: Elements that are regions of a page by their tag.
REGIONS = {"nav", "aside", "header", "footer", "form", "article", "main", "section"}
#: Elements that are parts of another, and so of its kind.
PARTS = {"li", "dt", "dd", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "figcaption", "summary"}
#: Elements that an opening tag of the named kind closes when they are open.
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"},
}
LISTS = {"ul", "ol", "dl", "table"}
#: Opening tags that end a skipped element without an end tag of its own.
FLOW = TEXT_BLOCKS | LISTS | {"body", "div", "article", "section", "main", "header", "footer", "nav", "aside", "form", "figure", "tr"}
#: Words in class, id and role that speak for or against content.
HINTS = {
    "content": "content article post entry story main body text".split(),
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs toc pagination tabs".split(),
    "header": "header banner masthead topbar".split(),
    "footer": "footer copyright colophon legal contentinfo".split(),
    "side": "sidebar related widget aside recommended complementary".split(),
    "notice": "cookie cookies consent notice alert popup modal gdpr overlay".split(),
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion".split(),
    "form": "form newsletter subscribe search login signup".split(),
    "comments": "comment comments disqus reply replies respond discussion thread".split(),
    "share": "share social sharing".split(),
}
HINT_OF = {w: k for k, ws in HINTS.items() for w in ws}


@dataclass(slots=True)
class Node:
    tag: str  # '#text' for a run of inline text
    hints: tuple[str, ...] = ()
    parent: int = -1
    parts: list[str] = field(default_factory=list)
    size: int = 0  # characters in and below it
    linked: int = 0  # those inside links
    share: int = 0  # fifths of the page's text outside links that are in and below it
    children: list[int] = field(default_factory=list)


class Ends:
    """Which opening tags of a page have an end tag of their own. Objects and images lie
    in each other, controls don't: there the next tag of the name must be the end."""

    def __init__(self, page: str):
        self.page, self.ended = page, {}

    def has(self, tag: str, start: int) -> bool:
        if tag not in self.ended:
            found, opened = set(), []
            for m in re.finditer(rf"<(/?){tag}(?=[\s/>])", self.page, re.I):
                if not m[1]:
                    opened = [*opened, m.start()] if tag in NESTED else [m.start()]
                elif opened:
                    found.add(opened.pop())
            self.ended[tag] = found
        return start in self.ended[tag]


def parse(page: str) -> list[Node]:
    """The nodes in page order, parents first. Inline elements dissolve into runs of
    text; comments, scripts, styles and forms' controls are left out. Hidden elements
    aren't, as a script may show them. What is left out ends like any element: by its end
    tag, an ancestor's, or an opening tag that implies it; the text that it stands in goes
    on behind it. A head has no text of its own, so its tags are passed over."""
    nodes = [Node("#root")]
    # every open element, its node (-1 where it is left out), whether FLOW ends it, and
    # the run of text that goes on behind it, in a link or not
    open_tags: list[tuple[str, int, bool, tuple[int, int]]] = [("#root", 0, False, (-1, 0))]
    ends = Ends(page)
    here, run, links = 0, -1, 0
    position = 0
    end = len(page)
    while position < end:
        m = TOKEN.match(page, position)
        if m is None:  # a tag that the page's end cuts off
            break
        start, position = position, m.end()
        slash, tag, rest, text = m.groups()
        if text is not None:
            if text == "<" and page[position : position + 1].isalpha() or page.startswith("/", position) and text == "<":
                position = page.find(">", position) + 1 or end  # a tag cut off, or with a quote that never ends
                continue
            if here < 0:
                continue
            if run < 0:
                if text.isspace():
                    continue
                run = len(nodes)
                nodes.append(Node("#text", parent=here))
                nodes[here].children.append(run)
            nodes[run].parts.append(text)
            if links:
                nodes[run].linked += len(text)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag in RAW:
            if not slash and not rest.endswith("/"):
                close = re.compile(rf"</{tag}\s*>", re.I).search(page, position)
                position = close.end() if close else end
            continue
        if tag in VOID:
            if tag == "hr":
                run = -1
            elif tag == "br" and run >= 0:
                nodes[run].parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if slash else 1
            continue
        before = (run, links) if tag in SKIPPED and here >= 0 else (-1, 0)
        run, links = -1, 0
        if tag == "head":
            continue
        if slash:
            for k in range(len(open_tags) - 1, 0, -1):
                if open_tags[k][0] == tag:
                    run, links = open_tags[k][3]
                    del open_tags[k:]
                    break
                if open_tags[k][0] in LISTS and tag in ("li", "td", "th", "tr", "dt", "dd"):
                    break
            else:
                run, links = before
            here = open_tags[-1][1]
            continue
        if here < 0 and tag in FLOW:
            loose = [k for k, x in enumerate(open_tags) if x[2]]
            if loose:
                del open_tags[loose[0] :]
                here = open_tags[-1][1]
        left_out = tag in SKIPPED
        if (left_out or here < 0) and rest.endswith("/"):
            run, links = before
            continue
        closes = CLOSED_BY.get(tag, set())
        for k in range(len(open_tags) - 1, 0, -1):
            if tag in SKIPPED:  # stands inside a paragraph
                break
            if open_tags[k][0] == "p" or open_tags[k][0] in closes:
                del open_tags[k:]
                break
            if open_tags[k][0] in LISTS or open_tags[k][0] in SKIPPED:
                break
        here = open_tags[-1][1]
        if left_out or here < 0:
            here = -1
            open_tags.append((tag, here, left_out and not ends.has(tag, start), before))
            continue
        # classes of the whole page tell of its parts ("has-sidebar"), not of its text
        words = [] if tag in ("html", "body") else [w for a in ATTRIBUTE.finditer(rest) for w in re.split(r"[^a-z]+", (a[2] or a[3] or a[4] or "").lower())]
        nodes.append(Node(tag, tuple(sorted({HINT_OF[w] for w in words if w in HINT_OF})), here))
        nodes[here].children.append(len(nodes) - 1)
        here = len(nodes) - 1
        open_tags.append((tag, here, False, (-1, 0)))
    for node in reversed(nodes):
        node.size += sum(map(len, node.parts))
        if node.parent >= 0:
            nodes[node.parent].size += node.size
            nodes[node.parent].linked += node.linked
    plain = max(nodes[0].size - nodes[0].linked, 1)
    for node in nodes:
        node.share = min(4, 5 * (node.size - node.linked) // plain)
    return nodes


def block_text(node: Node) -> str:
    return " ".join(unescape("".join(node.parts)).split())


#: Sorts of edges: to a text run in a text block, to one elsewhere, to a block, list, table
#: or division without a name, to one with a name or a region, to an element right below
#: the body or above it, to a part of a list, table or figure.
SORTS = 6


def sort_of(nodes: list[Node], v: int) -> int:
    node, parent = nodes[v], nodes[nodes[v].parent].tag
    if node.tag == "#text":
        return 0 if parent in TEXT_BLOCKS else 1
    if parent in ("#root", "html", "body"):
        return 4
    if node.tag in PARTS and not node.hints:
        return 5
    return 3 if node.hints or node.tag in REGIONS else 2


def _tag(node: Node) -> str:
    """A division with a name is another thing than one without."""
    return f"tag={node.tag}{'+' if node.hints else ''}"


def features(node: Node) -> list[str]:
    out = ["bias", _tag(node), *[f"hint={h}" for h in node.hints]]
    kind = "text" if node.tag == "#text" else "all"
    out.append(f"text size={min(8, node.size.bit_length())}" if kind == "text" else f"share={node.share}")
    out.append(f"{kind} links={min(4, 4 * node.linked // max(node.size, 1))}")
    return out


@dataclass
class Model:
    weights: dict[str, float]
    edges: tuple[float, ...]

    def own(self, node: Node) -> float:
        """A node's own log odds. An element that training never met says nothing but by
        the words in its attributes, so its parent and children decide."""
        known = _tag(node) in self.weights
        return sum(self.weights.get(f, 0.0) for f in features(node) if known or f.startswith("hint="))

    def marginals(self, nodes: list[Node]) -> np.ndarray:
        """P(content) of each node. Messages are log odds."""
        n = len(nodes)
        total = [self.own(v) for v in nodes]
        pull = [0.0, *(self.edges[sort_of(nodes, v)] for v in range(1, n))]
        up = [0.0] * n
        for v in range(n - 1, 0, -1):  # children come after their parents
            up[v] = _passed(total[v], pull[v])
            total[nodes[v].parent] += up[v]
        for v in range(1, n):
            total[v] += _passed(total[nodes[v].parent] - up[v], pull[v])
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def _passed(odds: float, pull: float) -> float:
    """The log odds that an edge of agreement weight pull passes on."""
    return 2 * math.atanh(max(-1 + 1e-12, min(1 - 1e-12, math.tanh(pull) * math.tanh(odds / 2))))


def labels_of(marked: str) -> tuple[list[Node], np.ndarray]:
    """Nodes of a labelled page and whether each is content; a node with children is
    content if most of the text under it is."""
    parts = re.split("([\x01\x02])", marked)
    clean = "".join(p for p in parts if p not in "\x01\x02" or not p)
    spans, at, start = [], 0, None
    for p in parts:
        if p == "\x01":
            start = at
        elif p == "\x02":
            spans.append((start, at))
        else:
            at += len(p)
    nodes = parse(clean)
    good, size = np.zeros(len(nodes)), np.zeros(len(nodes))
    seek = 0
    for v, node in enumerate(nodes):
        if node.tag == "#text":
            found = clean.find(node.parts[0], seek)
            seek = found + 1 if found >= 0 else seek
            size[v] = sum(map(len, node.parts))
            good[v] = size[v] * any(a <= found < b for a, b in spans)
    for v in range(len(nodes) - 1, 0, -1):
        good[nodes[v].parent] += good[v]
        size[nodes[v].parent] += size[v]
    inside = good * 2 > size
    return nodes, inside


def fit(pages: list[tuple[list[Node], np.ndarray]], steps: int = STEPS, rate: float = 0.05, ridge: float = 1e-4) -> Model:
    """Maximises the likelihood of the labels, by Adam. The gradient is what the labels
    show less what sum-product expects, over all pages at once, level by level."""
    names: dict[str, int] = {}
    rows, depth, parent, sort, truth = [], [], [], [], []
    for nodes, inside in pages:
        base = len(rows)
        for v, node in enumerate(nodes):
            rows.append([names.setdefault(f, len(names)) for f in features(node)])
            depth.append(0 if v == 0 else depth[base + node.parent] + 1)
            parent.append(base + max(node.parent, 0))
            sort.append(0 if v == 0 else sort_of(nodes, v))
            truth.append(bool(inside[v]))
    feature = np.array([f for r in rows for f in r])
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    y, depth, parent, sort = np.array(truth, float), np.array(depth), np.array(parent), np.array(sort)
    levels = [np.flatnonzero(depth == d) for d in range(1, depth.max() + 1)]
    edge = np.flatnonzero(depth > 0)
    seen = (2 * y[edge] - 1) * (2 * y[parent[edge]] - 1)
    w = np.append(np.zeros(len(names)), np.full(SORTS, 0.5))
    first, second = np.zeros_like(w), np.zeros_like(w)
    passed = lambda odds, j: 2 * np.arctanh(np.clip(np.tanh(j) * np.tanh(odds / 2), -1 + 1e-12, 1 - 1e-12))
    for t in range(1, steps + 1):
        pull = w[-SORTS:][sort]
        below = np.bincount(owner, w[feature], len(y))  # own and children's log odds
        up = np.zeros(len(y))
        for v in reversed(levels):
            up[v] = passed(below[v], pull[v])
            below += np.bincount(parent[v], up[v], len(y))
        total = below.copy()
        for v in levels:
            total[v] += passed(total[parent[v]] - up[v], pull[v])
        p = 1 / (1 + np.exp(-np.clip(total, -50, 50)))
        a, b = np.clip(total[parent[edge]] - up[edge], -40, 40), np.clip(below[edge], -40, 40)
        same = np.exp(2 * pull[edge]) * np.cosh((a + b) / 2)
        differ = np.cosh((a - b) / 2)
        surprise = seen - (same - differ) / (same + differ)
        gradient = np.append(np.bincount(feature, (y - p)[owner], len(names)), np.bincount(sort[edge], surprise, SORTS)) / len(y) - ridge * w
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        w += rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        w[-SORTS:] = np.clip(w[-SORTS:], 0, 6)
    return Model({f: float(w[i]) for f, i in names.items()}, tuple(float(v) for v in w[-SORTS:]))


@lru_cache(1)
def trained(n_pages: int = TRAINING_PAGES) -> Model:
    return fit([labels_of(labelled_page(seed)) for seed in range(n_pages)])


def main_text(page: str, model: Model) -> str:
    nodes = parse(page)
    content = model.marginals(nodes) > 0.5
    blocks = (block_text(v) for v, c in zip(nodes, content, strict=True) if c and v.tag == "#text")
    return "\n".join(b for b in blocks if b)


def extract_text(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    model: Model | None = None,
) -> DataFrame:
    """One row per input row: page_id, url, text (blocks joined by line feeds, empty if
    none), n_chars.

    Null pages are empty. Broken and cut-off markup is read as far as it goes. Null ids
    and repeated rows are kept; an empty table gives an empty result; other columns are
    ignored. Without a model, the one fitted on TRAINING_PAGES generated pages is used.
    """
    model = model or trained()

    def run(batch: pa.RecordBatch) -> dict:
        texts = [main_text(t, model) for t in texts_of(batch.column("html"))]
        return {
            "page_id": batch.column("page_id"),
            "url": batch.column("url"),
            "text": texts,
            "n_chars": [len(t) for t in texts],
        }

    own = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.col(f"`{html_col}`").cast("string").alias("html"),
    )
    return map_batches(own, run, "page_id long, url string, text string, n_chars long")
