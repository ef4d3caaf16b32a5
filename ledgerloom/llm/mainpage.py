"""Main text of web pages by a minimum cut between content and boilerplate.

A page becomes blocks of text in page order, each with the elements it stands in. A linear classifier
over the kinds of those elements (tags, class and id words, roles, hidden ones), link share, length, tag and punctuation turns each block into two costs,
which are the capacities of its edges to the terminals. Blocks that follow each other and blocks
under the same element are tied by smoothness edges, stronger the closer they stand in the tree. The maximum flow
separates content from boilerplate; content blocks are joined by two newlines.

The classifier is fitted by logistic regression on the driver, on a sample of pages of at most ``train_chars`` characters. Pages carry no labels, so a
rule gives them: a block in an article or main element whose other elements speak for nothing else is content; one in an element of
navigation, footer, aside, form, control, head or hidden content, or one whose class, id or role says so, is boilerplate; all
others have no label. Weights have a normal prior around ``PRIOR``, against which ten blocks of the sample count as one, and all as ``STRENGTH`` at
most, so what the sample doesn't show stays as stated.

Edge cases: null, empty and text-free pages give the empty string and 0; unclosed and stray tags, comments and
raw-text elements are read as browsers do, as far as text is concerned (``<!-->`` is a whole comment, templates nest, xmp is shown as it stands); drawings (svg) have no text, formulas keep theirs; a block that costs the same on both sides is boilerplate; pages of any length are read whole; repeated rows
give equal results; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_rows, sample_keys, sampled, sliced

_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*(?:"[^"]*"|'[^']*')?|["'])*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")
_NAME_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text isn't shown and holds no tags.
RAW = frozenset("script style noscript textarea title iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul xmp".split()
)
#: Controls and fallbacks: blocks of their own that leave an open paragraph open. Those left open end before a block that they can't hold.
CONTROLS = frozenset("option optgroup select datalist button object".split())
_HOLDS = {"option": frozenset(), "optgroup": frozenset(["option"]), "select": frozenset(["option", "optgroup", "hr"]), "datalist": frozenset(["option"]), "button": frozenset(["div", "object"]), "object": (BLOCKS | CONTROLS) - {"article", "main"}}
_EMPTY = re.compile(r"""(?:^|[\s"'])/\s*\Z""")
#: Tags of HTML that end an open svg.
_LEAVES_SVG = (BLOCKS | frozenset("a b big br code em embed font i img s small span strike strong sub sup tt u var".split())) - frozenset("a html caption fieldset".split())
#: An opening tag of a key ends an open element of its set, up to one of ``_SCOPES``.
_CLOSES = {t: frozenset(["p"]) for t in BLOCKS - {"html", "head", "body", "tr", "tbody", "thead", "tfoot", "caption"}}
_CLOSES |= {"li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"])}
_CLOSES |= {t: frozenset(["p", "h1", "h2", "h3", "h4", "h5", "h6"]) for t in ("h1", "h2", "h3", "h4", "h5", "h6")}
_SCOPES = frozenset("table ul ol dl body html article section main div aside nav header footer form blockquote".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion promoted nav navbar navigation menu breadcrumb breadcrumbs sidebar sidenav aside rail footer foot header masthead topbar cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup signin login register share sharing social related recommended recommendations more trending popular comment comments commentlist respond reply replies disqus discussion widget widgets popup modal overlay toolbar pagination pager tags taglist copyright legal disclaimer search skip print byline".split()
)
CONTENT_WORDS = frozenset("article content main post entry story body text articlebody maincontent prose".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
#: Ties of blocks that follow each other, and of blocks under one element.
TIE, PARENT_TIE = 0.8, 0.5
#: What an element may be, by its tag.
TAG_KINDS = {
    "nav": "navigation", "menu": "navigation", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "dialog": "form", "search": "form", "fieldset": "form", "legend": "form",
    "option": "control", "optgroup": "control", "select": "control", "datalist": "control", "button": "control", "object": "object", "head": "head", "article": "article", "main": "main",
}
#: Kinds of elements around a block, the prior means of their weights, and whether they speak for content.
KINDS = {
    "navigation": (-7.0, False), "header": (-3.0, False), "footer": (-6.0, False), "aside": (-6.0, False), "form": (-6.0, False), "control": (-14.0, False), "object": (-6.0, False), "head": (-20.0, False), "article": (4.0, True), "main": (3.0, True),
    "named boilerplate": (-6.0, False), "named content": (2.0, True), "boilerplate role": (-6.0, False), "content role": (3.0, True), "hidden": (-9.0, False), "boilerplate inside content": (-3.0, False),
}
BIT = {kind: 1 << i for i, kind in enumerate(KINDS)}
FOR = sum(BIT[k] for k, (_, good) in KINDS.items() if good)
AGAINST = sum(BIT[k] for k, (_, good) in KINDS.items() if not good)
#: Prior means: of the kinds, the bias, the link share, the length, a text tag and a closing mark.
PRIOR = np.array([*(w for w, _ in KINDS.values()), -0.2, -3.5, 0.5, 1.0, 0.7])
#: Blocks that a sample counts as at most, and the precision of the prior: pages of one make must not outweigh all other kinds of pages.
STRENGTH, PRECISION = 200.0, 8.0
TEXT_TAGS = frozenset("p blockquote pre h1 h2 h3 h4 h5 h6".split())
CLOSING = ".!?…。！？\"'”’»)"
#: Costs are bounded, so that ties can outweigh them.
LOWEST, HIGHEST = -12.0, 8.0


class Element:
    """An element and the kinds of all elements it stands in, as bits."""

    __slots__ = ("depth", "kinds", "number", "parent", "tag")

    def __init__(self, tag: str, attributes: str, parent: Element | None, number: int):
        self.tag, self.parent, self.number = tag, parent, number
        self.depth = parent.depth + 1 if parent else 0
        around = parent.kinds if parent else 0
        own = BIT.get(TAG_KINDS.get(tag, ""), 0)
        if own == BIT["header"] and around & FOR:
            own = 0
        if attributes and not attributes.isspace():
            own |= named(attributes, tag)
        if own & AGAINST and around & FOR:
            own |= BIT["boilerplate inside content"]
        self.kinds = around | own


def named(attributes: str, tag: str) -> int:
    """What an element's attributes say: class and id words, role, hidden."""
    kinds, words = 0, set()
    for name, a, b, c in _ATTR.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            words.update(_NAME_WORDS.findall(_CAMEL.sub(" ", value).lower()))
        elif name == "role":
            kinds |= BIT["boilerplate role"] if value.lower() in BOILER_ROLES else BIT["content role"] if value.lower() in ("main", "article") else 0
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
            kinds |= BIT["hidden"]
    if tag not in ("html", "body"):
        if words & BOILER_WORDS:
            kinds |= BIT["named boilerplate"]
        elif words & CONTENT_WORDS:
            kinds |= BIT["named content"]
    return kinds


def after_svg(page: str, at: int) -> int:
    """Where an svg that opened before ``at`` ends: past its end tag, or before a tag of HTML that can't stand in it."""
    depth, foreign = 1, 0
    while (lt := page.find("<", at)) >= 0:
        m = _TOKEN.match(page, lt)
        if not m:
            at = lt + 1
            continue
        at, tag = m.end(), (m[2] or "").lower()
        empty = m[2] is not None and bool(_EMPTY.search(m[3]))
        if tag == "svg":
            depth += -1 if m[1] else 0 if empty else 1
            if not depth:
                return at
        elif tag == "foreignobject":
            foreign = max(0, foreign + (-1 if m[1] else 0 if empty else 1))
        elif tag in ("script", "style") and not m[1] and not empty:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else at
        elif not foreign and tag in _LEAVES_SVG and (not m[1] or tag in BLOCKS):
            return lt
    return len(page)


def after_raw(page: str, tag: str, at: int) -> tuple[int, int]:
    """Where the raw text of an element that opened before ``at`` ends, and where its end tag does; the page's end without one."""
    close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
    return (close.start(), close.end()) if close else (len(page), len(page))


def after_template(page: str, at: int) -> int:
    """Where a template that opened before ``at`` ends; templates inside have end tags of their own."""
    depth = 1
    while (lt := page.find("<", at)) >= 0:
        m = _TOKEN.match(page, lt)
        if not m:
            at = lt + 1
            continue
        at, tag = m.end(), (m[2] or "").lower()
        if tag == "template":
            depth += -1 if m[1] else 1
            if not depth:
                return at
        elif not m[1] and (tag in RAW or tag == "xmp"):
            at = after_raw(page, tag, at)[1]
    return len(page)


def blocks_of(page: str) -> list[tuple[str, Element, float, str]]:
    """``(text, element, share of link text, tag)`` of each block, in page order."""
    root = Element("#", "", None, 0)
    stack, out = [root], []
    buffer: list[str] = []
    linked = at = number = 0
    in_link, end = 0, len(page)

    def text(part: str) -> None:
        nonlocal linked
        buffer.append(part)
        if in_link:
            linked += len(part)

    def flush() -> None:
        nonlocal linked
        raw = "".join(buffer)
        buffer.clear()
        if raw and not raw.isspace():
            clean = _SPACE.sub(" ", html.unescape(raw)).strip()
            if clean:
                out.append((clean, stack[-1], min(1.0, linked / max(1, len(raw))), stack[-1].tag))
        linked = 0

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        if lt > at:
            text(page[at:lt])
        m = _TOKEN.match(page, lt)
        if not m:
            text("<")
            at = lt + 1
            continue
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            elif tag in ("td", "th"):
                text(" ")
            if tag in BLOCKS or tag in CONTROLS:
                k = len(stack) - 1
                while k and stack[k].tag != tag:
                    k -= 1
                if k:
                    flush()
                    del stack[k:]
            continue
        if tag == "svg":
            if not _EMPTY.search(m[3]):
                at = after_svg(page, at)
            continue
        if tag == "template":
            at = after_template(page, at)
            continue
        if tag in RAW:
            at = after_raw(page, tag, at)[1]
            continue
        if tag == "br" or tag in ("td", "th"):
            text(" ")
        elif tag == "a":
            in_link += 1
        if tag in BLOCKS or tag in CONTROLS:
            flush()
            in_link = 0
            while stack[-1].tag in CONTROLS and tag not in _HOLDS[stack[-1].tag]:
                stack.pop()
            closes = _CLOSES.get(tag)
            if closes:
                k = len(stack) - 1
                while k and stack[k].tag not in _SCOPES and stack[k].tag not in closes:
                    k -= 1
                if k and stack[k].tag in closes:
                    del stack[k:]
            elif tag == "body":
                while len(stack) > 1 and stack[-1].tag == "head":
                    stack.pop()
            if tag not in VOID and not (tag in CONTROLS and _EMPTY.search(m[3])):
                number += 1
                stack.append(Element(tag, m[3], stack[-1], number))
            if tag == "xmp":  # shown as it stands: no tags, no character references
                stop, at = after_raw(page, tag, at)
                text(html.escape(page[m.end() : stop]))
                flush()
                stack.pop()
    flush()
    return out


def features(text: str, element: Element, links: float, tag: str) -> list[float]:
    """What the classifier sees of a block, in the order of ``PRIOR``."""
    kinds = element.kinds
    return [*((kinds >> i) & 1 for i in range(len(KINDS))), 1.0, *beside(text, links, tag)]


def beside(text: str, links: float, tag: str) -> tuple[float, float, float, float]:
    return links, min(3.0, math.log(len(text) / 40)), float(tag in TEXT_TAGS), float(text[-1] in CLOSING)


def label(element: Element) -> int | None:
    """The label that the rule gives a block: 1 content, 0 boilerplate, None neither."""
    kinds = element.kinds
    if kinds & AGAINST & ~BIT["header"]:
        return 0
    return 1 if kinds & (BIT["article"] | BIT["main"]) else None


def fit(pages: list[str]) -> np.ndarray:
    """Weights of largest posterior density, by Newton's method."""
    rows, labels = [], []
    for page in pages:
        for block in blocks_of(page):
            y = label(block[1])
            if y is not None:
                rows.append(features(*block))
                labels.append(y)
    if not rows:
        return PRIOR
    x, y = np.array(rows), np.array(labels, float)
    # Each block stands twice, once without its kinds: what it looks like must tell where elements say nothing.
    bare = x.copy()
    bare[:, : len(KINDS)] = 0
    x, y = np.concatenate((x, bare)), np.concatenate((y, y))
    # Both labels weigh the same, and all blocks together a tenth of their number, STRENGTH at most.
    share = np.where(y > 0, max(y.mean(), 1e-9), max(1 - y.mean(), 1e-9))
    weight = min(STRENGTH, len(y) / 10) / len(y) * 0.5 / share
    w = PRIOR.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + PRECISION * np.eye(len(w)), x.T @ (weight * (y - p)) - PRECISION * (w - PRIOR))
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Scores:
    """Log odds that a block is content; those of its elements are kept by their kinds."""

    def __init__(self, weights: np.ndarray):
        self.kinds, (self.bias, *self.others) = weights[: len(KINDS)].tolist(), weights[len(KINDS) :].tolist()
        self.known: dict[int, float] = {}

    def __call__(self, text: str, element: Element, links: float, tag: str) -> float:
        around = self.known.get(element.kinds)
        if around is None:
            around = self.known[element.kinds] = self.bias + sum(w for i, w in enumerate(self.kinds) if element.kinds >> i & 1)
        return max(LOWEST, min(HIGHEST, around + sum(w * v for w, v in zip(self.others, beside(text, links, tag), strict=True))))


def softplus(x: float) -> float:
    return x if x > 30 else math.log1p(math.exp(x))


def minimum_cut(n: int, terminals: list[tuple[float, float]], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Which of ``n`` nodes stay with the source; ``terminals`` are capacities from source and to sink."""
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def edge(a: int, b: int, there: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(there)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, (a, b) in enumerate(terminals):
        both = min(a, b)
        if a > both:
            edge(source, i, a - both, 0.0)
        elif b > both:
            edge(i, sink, b - both, 0.0)
    for a, b, w in ties:
        edge(a, b, w, w)
    eps = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            v = queue.popleft()
            for e in head[v]:
                w = to[e]
                if level[w] < 0 and room[e] > eps:
                    level[w] = level[v] + 1
                    queue.append(w)
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        nxt = [0] * (n + 2)
        path: list[int] = []
        v = source
        while True:
            if v == sink:
                push = min(room[e] for e in path)
                cut = 0
                for k in range(len(path) - 1, -1, -1):
                    e = path[k]
                    room[e] -= push
                    room[e ^ 1] += push
                    if room[e] <= eps:
                        cut = k
                del path[cut:]
                v = to[path[-1]] if path else source
                continue
            edges, k = head[v], nxt[v]
            while k < len(edges) and not (room[edges[k]] > eps and level[to[edges[k]]] == level[v] + 1):
                k += 1
            nxt[v] = k
            if k < len(edges):
                path.append(edges[k])
                v = to[edges[k]]
            elif not path:
                break
            else:
                level[v] = -1
                v = to[path.pop() ^ 1]


def extract(page: str | None, score: Scores | None = None) -> list[str]:
    """The content blocks of a page, by the prior weights unless others are given."""
    score = score or Scores(PRIOR)
    found = blocks_of(page or "")
    n = len(found)
    if not n:
        return []
    terminals, ties = [], []
    for block in found:
        s = score(*block)
        terminals.append((softplus(s), softplus(-s)))
    aux: dict[int, int] = {}
    for i, (_, element, _, _) in enumerate(found):
        above = element.parent or element
        if above.number not in aux:
            aux[above.number] = n + len(aux)
            terminals.append((0.0, 0.0))
        ties.append((i, aux[above.number], PARENT_TIE))
        if i:
            a, b = found[i - 1][1], element
            x, y = a, b
            while x is not y:
                if x.depth >= y.depth:
                    x = x.parent
                else:
                    y = y.parent
            ties.append((i - 1, i, TIE / (1 + max(0, a.depth + b.depth - 2 * x.depth - 2))))
    side = minimum_cut(n + len(aux), terminals, ties)
    return [found[i][0] for i in range(n) if side[i]]


def main_text(df: DataFrame, *, id_col: str = "page_id", html_col: str = "html", with_blocks: bool = False, train_chars: int = 3_000_000) -> DataFrame:
    """``(id, text, n_chars)`` of each page; with ``with_blocks`` also ``blocks array<string>``."""
    pages = df.where(F.length(html_col) > 0).select(F.lit(0).alias("label"), F.xxhash64(html_col).alias("hash"), F.length(html_col).alias("size"), F.col(html_col).alias("html"))
    keys, _ = sample_keys(pages.drop("html"), train_chars)
    weights = fit(sorted(r["html"] for r in sampled(pages, keys, "html")))

    def run(batches):
        score = Scores(weights)
        for batch in sliced(batches):
            blocks = [extract(page, score) for page in batch.column(1).to_pylist()]
            texts = ["\n\n".join(b) for b in blocks]
            columns = [batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            names = [id_col, "text", "n_chars"]
            if with_blocks:
                columns, names = [*columns, pa.array(blocks, pa.list_(pa.string()))], [*names, "blocks"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_rows(df, id_col, html_col, run, "text string, n_chars long" + (", blocks array<string>" if with_blocks else ""))
