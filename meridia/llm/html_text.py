"""Main text of web pages by a tree-structured graphical model.

Every element and text of a page is a node with a hidden mark, content or not. A node has a
unary potential from its own features (element, words of its class and id, links, length),
each parent-child edge a potential that depends on the child's kind. Sum-product message
passing upward and downward gives each node's exact marginal; texts with a marginal over
one half are the main text. Both potentials are trained together on labelled pages, by
gradient steps on the likelihood of all marks of a page.

Pages are independent: one scan, no shuffle, one page in memory at a time beside its batch.

Text that isn't shown (hidden, display:none) isn't main text. A page without any element
but inline ones, and without names (class, id, role), is text alone and main text as a whole.
Parsing takes time in proportion to the page, however deep its elements are and whatever its end
tags close.

Defined results: null and empty pages and pages without main text give an empty text; broken
markup is closed as browsers do for the common cases; urls and ids may be null or repeat; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import html
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .html_pages import labelled_page
from .scratch import bound_batches

#: Labelled pages to train on.
PAGES = 400
_TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
# Fixed values of the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_FOREIGN = frozenset(("svg", "math"))
#: Start tags that end an open svg or math, but for those inside the elements of _INSIDE.
_BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span "
    "strike strong sub sup table tt u ul var".split()
)
_INSIDE = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "tbody": "tbody thead tr td th", "tfoot": "tbody thead tr td th"}
_STOPS = frozenset("ul ol dl table article section main aside nav header footer form body html".split())
_ENDS_P = _BLOCK - {"br", "body", "html", "head", "li", "dd", "dt", "td", "th", "tr", "caption", "tbody", "thead", "tfoot", "option", "optgroup", "legend"}
#: Nodes of a page that is text alone.
_PLAIN = frozenset("#root #text #raw html head meta link base body br hr wbr a abbr b cite code em i q s small span strong sub sup u".split())
#: Words of class and id names that tell page parts apart.
_WORDS = frozenset(
    "ad ads advert advertisement alert article aside banner body bar breadcrumb colophon comment comments consent contact container content cookie copyright disclaimer "
    "disqus entry follow footer form header hidden legal login main masthead menu modal nav navbar newsletter notice overlay page pager pagination popup post promo rail reader "
    "recommended related replies respond row search share side sidebar signup site slot social sponsor sponsored story subscribe tags text toolbar topbar widget wrap".split()
)
_SPLIT = re.compile(r"[^a-z]+")


@dataclass
class Page:
    """Nodes in document order, parents before children; node 0 is the document."""

    parent: list[int]
    name: list[str]  # element, '#text' for a text
    words: list[str]  # of class, id and role
    mark: list[int]  # of labelled pages, from data-y: 1, 0, or -1
    text: list[str]
    breaks: list[int]  # block boundaries before the node


def _names(attributes: str, marks: bool) -> tuple[str, int]:
    """Words of class, id and role, and 'hidden' of what isn't shown; the mark of a labelled page."""
    words, mark = "", -1
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id", "role"):
            words += " " + value.lower()
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _UNSEEN.search(value)):
            words += " hidden"
        elif marks and name == "data-y" and value in ("0", "1"):
            mark = int(value)
    return words, mark


def parse(source: str | None, marks: bool = False) -> Page:
    """The page's nodes; ``marks`` reads the labels of training pages."""
    page = Page([-1], ["#root"], [""], [-1], [""], [0])
    stack, pos, breaks = [0], 0, 0
    source = source or ""

    def add(name: str, words: str = "", mark: int = -1, text: str = "") -> int:
        page.parent.append(stack[-1])
        page.name.append(name)
        page.words.append(words)
        page.mark.append(mark)
        page.text.append(text)
        page.breaks.append(breaks)
        return len(page.name) - 1

    # where on the stack the open elements of a name are, and those of each set, so that an end
    # tag needs no look through all that is open
    where: dict[str, list[int]] = {}
    open_of: dict[frozenset, list[int]] = {_STOPS: [], _INSIDE: [], _FOREIGN: []}

    def push(node: int) -> None:
        name = page.name[node]
        where.setdefault(name, []).append(len(stack))
        for names, places in open_of.items():
            if name in names:
                places.append(len(stack))
        stack.append(node)

    def cut(k: int) -> None:
        while len(stack) > k:
            name = page.name[stack.pop()]
            where[name].pop()
            for names, places in open_of.items():
                if name in names:
                    places.pop()

    def close(names: frozenset | set, stopped: bool) -> None:
        """Ends the innermost open element of these names, unless one of _STOPS is further in."""
        k = max((where[n][-1] for n in names if where.get(n)), default=0)
        if k and not (stopped and open_of[_STOPS] and open_of[_STOPS][-1] > k):
            cut(k)

    def foreign() -> int:
        """Place on the stack of the innermost svg or math that is open here, or 0."""
        k = open_of[_FOREIGN][-1] if open_of[_FOREIGN] else 0
        return 0 if open_of[_INSIDE] and open_of[_INSIDE][-1] > k else k

    drawn = False  # whether the page has had an svg or math
    for m in iter(lambda: _TAG.search(source, pos), None):
        if m.start() > pos:
            add("#text", text=html.unescape(source[pos : m.start()]))
        pos = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if name in _BLOCK:
            breaks += 1
        if m[1] or m[4]:
            close({name}, name not in _BLOCK)
            continue
        if drawn and name in _BREAKOUT and (k := foreign()):
            while page.name[stack[k - 1]] in _FOREIGN:
                k -= 1
            cut(k)
        if name in _CLOSES:
            for _ in range(2):
                close(frozenset(_CLOSES[name].split()), True)
        if name in _ENDS_P:
            close({"p"}, True)
        if name in _RAW and not (drawn and m[0].endswith("/>") and foreign()):
            end = re.compile(f"</{re.escape(name)}[\\s/>]", re.I).search(source, pos)
            pos = end.start() if end else len(source)
            add("#raw")  # its end tag finds no element of that name
            continue
        attributes = m[3] or m[6]
        words, mark = _names(attributes, marks) if attributes else ("", -1)
        node = add(name, words, mark)
        drawn = drawn or name in _FOREIGN
        if name not in _VOID and not m[0].endswith("/>"):
            push(node)
    if pos < len(source):
        add("#text", text=html.unescape(source[pos:]))
    return page


@functools.lru_cache(4096)
def _words_of(names: str) -> tuple[str, ...]:
    return tuple(sorted({w for w in _SPLIT.split(names) if w in _WORDS}))


@functools.lru_cache(8192)
def _kind(name: str, names: str) -> str:
    """A node's kind for edge potentials."""
    words = _words_of(names)
    return f"{name} {words[0] if words else ''}"


def _bucket(n: int) -> int:
    return min(9, n.bit_length())


def node_features(page: Page) -> list[list[str]]:
    n = len(page.name)
    size, linked, forms = [0] * n, [0] * n, [0] * n
    for k in range(n - 1, 0, -1):
        name = page.name[k]
        if name == "#text":
            size[k] = len(page.text[k].strip())
        elif name == "a":
            linked[k] = size[k]
        elif name in ("input", "button", "label"):
            forms[k] += 1
        p = page.parent[k]
        size[p] += size[k]
        linked[p] += linked[k]
        forms[p] += forms[k]
    out = []
    for k in range(n):
        name = page.name[k]
        if name == "#text":
            out.append(["text", f"text {_bucket(size[k])}", "text in " + page.name[page.parent[k]]])
        else:
            words = _words_of(page.words[k]) if page.words[k] else ()
            found = [f"<{name}>", f"<{name}> in {page.name[page.parent[k]]}", f"links {10 * linked[k] // size[k] if size[k] else -1}", f"size {_bucket(size[k])}", *("." + w for w in words)]
            out.append([*found, "forms"] if forms[k] and name not in ("body", "html", "#root") else found)
    return out


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]  # of features, in log odds of content
    edges: dict[str, tuple[float, float, float, float]]  # by child's kind: (parent, child) = 00, 01, 10, 11
    other: dict[str, tuple[float, float, float, float]]  # by element alone, and '' for all

    def edge(self, name: str, names: str) -> tuple[float, float, float, float]:
        return self.edges.get(_kind(name, names)) or self.other.get(name) or self.other[""]

    def marginals(self, page: Page) -> list[float]:
        """Log odds of content of each node: sum-product, upward and then downward."""
        n, parent, weights, exp, log = len(page.name), page.parent, self.weights, math.exp, math.log
        edge = [self.edge(a, b) for a, b in zip(page.name, page.words, strict=True)]
        up = [min(30.0, max(-30.0, sum([weights.get(f, 0.0) for f in found]))) for found in node_features(page)]
        message = [0.0] * n
        for k in range(n - 1, 0, -1):
            e00, e01, e10, e11 = edge[k]
            o = exp(up[k])
            message[k] = log((e10 + e11 * o) / (e00 + e01 * o))
            p = parent[k]
            up[p] = min(60.0, max(-60.0, up[p] + message[k]))
        for k in range(1, n):  # the parent's odds without what the child has sent it
            e00, e01, e10, e11 = edge[k]
            o = exp(min(60.0, max(-60.0, up[parent[k]] - message[k])))
            up[k] = min(60.0, max(-60.0, up[k] + log((e01 + e11 * o) / (e00 + e10 * o))))
        return up


class _Forest:
    """All nodes of the labelled pages, for sum-product passes over one depth at a time."""

    def __init__(self, pages: list[str]):
        parent, depth, marks, features, kinds = [], [], [], [], []
        for source in pages:
            page = parse(source, marks=True)
            base = len(parent)
            found = node_features(page)
            for k in range(len(page.name)):
                p = page.parent[k]
                parent.append(base + p if k else -1)
                depth.append(depth[base + p] + 1 if k else 0)
                marks.append(0 if not k else page.mark[k] if page.mark[k] >= 0 else marks[base + p])
                features.append(found[k])
                kinds.append(("", page.name[k], _kind(page.name[k], page.words[k])))
        self.parent, self.depth, self.marks = (np.array(x) for x in (parent, depth, marks))
        self.levels = [np.flatnonzero(self.depth == d) for d in range(self.depth.max() + 1)]
        self.features = {f: i for i, f in enumerate(dict.fromkeys(f for found in features for f in found))}
        self.kinds = {k: i for i, k in enumerate(dict.fromkeys(k for three in kinds for k in three))}
        self.at = np.repeat(np.arange(len(features)), [len(f) for f in features])
        self.to = np.array([self.features[f] for found in features for f in found])
        self.kind = np.array([[self.kinds[k] for k in three] for three in kinds])

    def gradient(self, w: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected minus observed counts of features and of edge marks."""
        n = len(self.parent)
        up = np.bincount(self.at, w[self.to], n)
        edge = e[self.kind].sum(axis=1)  # of all nodes, of the element, of the element and class
        message, odds, cavity = np.zeros(n), np.zeros(n), np.zeros(n)
        for k in reversed(self.levels[1:]):
            message[k] = np.logaddexp(edge[k, 1, 0], edge[k, 1, 1] + up[k]) - np.logaddexp(edge[k, 0, 0], edge[k, 0, 1] + up[k])
            up += np.bincount(self.parent[k], message[k], n)
        odds[self.levels[0]] = up[self.levels[0]]
        for k in self.levels[1:]:
            cavity[k] = odds[self.parent[k]] - message[k]
            odds[k] = up[k] + np.logaddexp(edge[k, 0, 1], edge[k, 1, 1] + cavity[k]) - np.logaddexp(edge[k, 0, 0], edge[k, 1, 0] + cavity[k])
        real = self.depth > 0
        error = np.where(real, 1 / (1 + np.exp(-np.clip(odds, -40, 40))) - self.marks, 0)
        cells = [edge[:, 0, 0], edge[:, 0, 1] + up, edge[:, 1, 0] + cavity, edge[:, 1, 1] + cavity + up]  # by (parent, child)
        top = np.maximum(np.maximum(cells[0], cells[1]), np.maximum(cells[2], cells[3]))
        cells = [np.exp(c - top) for c in cells]
        whole, seen = sum(cells), 2 * self.marks[self.parent] + self.marks
        cells = [np.where(real, c / whole - (seen == k), 0) for k, c in enumerate(cells)]
        pairs = sum(np.stack([np.bincount(kind, c, len(e)) for c in cells], axis=1) for kind in self.kind.T).reshape(e.shape)
        return np.bincount(self.to, error[self.at], len(w)), pairs


def train(pages: list[str], steps: int = 250, ridge: float = 1.0) -> Model:
    """Unary and edge potentials that maximise the likelihood of the marks (``data-y``) on
    labelled pages. The gradient needs the marginals, so each step is a sum-product pass;
    evidence that many children repeat is thereby weighed as often as it is worth."""
    forest = _Forest(pages)
    at = [np.zeros(len(forest.features)), np.zeros((len(forest.kinds), 2, 2))]
    first, second = [np.zeros_like(x) for x in at], [np.zeros_like(x) for x in at]
    for t in range(1, steps + 1):
        for x, a, b, g in zip(at, first, second, forest.gradient(*at), strict=True):
            g = g + ridge * x
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            x -= 0.1 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
    w, e = at
    known = {k: e[i] for k, i in forest.kinds.items()}
    whole = known[""]
    bare = lambda name: whole + known.get(name, 0)
    tuples = lambda x: tuple(np.exp(x - x.max()).clip(1e-12).ravel().tolist())
    edges = {k: tuples(bare(k.split(" ")[0]) + v) for k, v in known.items() if " " in k}
    other = {k: tuples(bare(k)) for k in known if " " not in k and k} | {"": tuples(whole)}
    return Model({f: float(w[i]) for f, i in forest.features.items()}, edges, other)


@functools.cache
def default_model() -> Model:
    return train([labelled_page(k) for k in range(PAGES)])


def main_text(source: str | None, model: Model) -> str:
    page = parse(source)
    # text alone, without an element or a name that could tell its parts apart, is all main text
    alone = _PLAIN.issuperset(page.name) and not any(page.words)
    odds = [1.0] * len(page.name) if alone else model.marginals(page)
    blocks: list[list[str]] = []
    at = -1
    for k, name in enumerate(page.name):
        if name == "#text" and odds[k] > 0:
            if page.breaks[k] != at:
                blocks.append([])
                at = page.breaks[k]
            blocks[-1].append(page.text[k])
    return " ".join(filter(None, (" ".join("".join(b).split()) for b in blocks)))


def extract_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    model = model or default_model()
    bound_batches(pages.sparkSession)

    def run(batches):
        for b in batches:
            texts = [main_text(x.as_py(), model) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
