"""Main text of web pages by a tree-structured graphical model.

The page's block elements are the nodes of a tree. Each has a hidden label, content or not. Unary potentials come from an element's tag,
names, text and links; pairwise potentials tie a child's label to its parent's, by kind of child. Sum-product
message passing, once upward and once downward, gives each node's marginal. The weights maximise the likelihood of labelled pages
(``labelled_pages``), with expected counts from the same messages.

The text of nodes whose marginal is above one half is kept, in page order.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrel.llm.html_pages import labelled_pages

#: Elements by what they do to the tree.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes template svg math select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr nobr output button".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table td th tr ul tbody thead tfoot".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tfoot"), "thead": ("tbody", "thead", "tfoot"), "tfoot": ("tbody", "thead", "tfoot")}
SCOPE = frozenset("ul ol table dl body html article section div td th main aside nav".split())
FOREIGN = frozenset("svg math".split())
#: Without a closing tag these take the rest of the page; of the others the tag alone is passed over.
UNCLOSED = frozenset("script style textarea title xmp".split())
NEVER = frozenset("head script style textarea title template svg math select iframe noembed noframes xmp noscript".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?/][^>a-zA-Z][^>]*(?:>|\Z)|<![^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)(>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][^\s=>/]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
#: A character reference by number: more digits than this name no character.
_REFERENCE = re.compile(r"&#(?:[0-9]{9,}|[xX][0-9a-fA-F]{8,});?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NAMED = ("class", "id", "role", "itemprop", "aria-label")


@lru_cache(maxsize=64)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I)


def decoded(text: str) -> str:
    """The text with its character references replaced; one of any length that names no character is U+FFFD, as in browsers."""

    def short(m: re.Match) -> str:
        digits = m[0].removeprefix("&#").rstrip(";")
        hexadecimal = digits[0] in "xX"
        digits = digits.lstrip("xX").lstrip("0") or "0"
        return "\ufffd" if len(digits) > 7 else f"&#{'x' if hexadecimal else ''}{digits};"

    return entities.unescape(_REFERENCE.sub(short, text))


@dataclass
class Node:
    tag: str
    parent: int
    names: list[str] = field(default_factory=list)
    runs: list[int] = field(default_factory=list)
    never: bool = False
    label: int | None = None
    chars: int = 0
    linked: int = 0
    links: int = 0
    stops: int = 0
    below: int = 0
    below_linked: int = 0
    depth: int = 0
    at: int = 0


def parse(page: str | None, labelled: bool = False) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block nodes, parents before children, and text runs (node, text) in page order; a run ends at a block's edge.

    ``labelled``: a training page, whose ``data-y`` attributes are its labels. On any other page they mean nothing.
    """
    page = page or ""
    nodes = [Node("#page", -1)]
    stack: list[tuple[str, int]] = [("#page", 0)]  # open elements and the block node that each is in
    runs: list[tuple[int, str]] = []
    held: list[str] = []
    held_links, anchors, at = 0, 0, 0

    def end_run():
        nonlocal held_links
        if held:
            text = _SPACE.sub(" ", decoded("".join(held))).strip()
            if text:
                n = nodes[stack[-1][1]]
                n.runs.append(len(runs))
                runs.append((stack[-1][1], text))
                n.chars += len(text)
                n.linked += min(held_links, len(text))
                n.stops += sum(text.count(c) for c in ".!?,;")
                n.at = n.at or at
            held.clear()
        held_links = 0

    def close(depth: int):
        nonlocal anchors
        while len(stack) > depth:
            tag = stack[-1][0]
            if tag not in INLINE:
                end_run()
            elif tag == "a":
                anchors -= 1
            stack.pop()

    def find(tags, stop=()) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                return i
            if stack[i][0] in stop:
                return 0
        return 0

    def text(piece: str):
        nonlocal held_links
        if piece:
            held.append(piece)
            if anchors:
                held_links += len(piece.strip())

    while at < len(page):
        found = page.find("<", at)
        if found < 0:
            text(page[at:])
            break
        if found > at:
            text(page[at:found])
        m = _TAG.match(page, found)
        if m is None:
            text("<")
            at = found + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        if not m[4]:
            break  # the page ends inside a tag
        tag = m[2].lower()
        if m[1]:
            if tag in ("br", "p") and tag == "br":
                text(" ")
            elif i := find((tag,)):
                close(i)
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in ENDS_P and (i := find(("p",), ("button", "table", "td", "th"))):
            close(i)
        if tag in SAME and (i := find(SAME[tag], SCOPE)):
            close(i)
        block = tag not in INLINE and (tag in ENDS_P or tag not in VOID)
        if block or tag == "hr":
            end_run()
        here = stack[-1][1]
        if block:
            node = Node(tag, here, depth=nodes[here].depth + 1, never=nodes[here].never or tag in NEVER)
            for name, *values in _ATTRIBUTE.findall(m[3]):
                name, value = name.lower(), next((v for v in values if v), "")
                if name in NAMED:
                    node.names += [p.lower().removesuffix("s") for p in _PART.findall(value)]
                elif name == "hidden" or name == "style" and _HIDDEN.search(value) or name == "aria-hidden" and value.lower() == "true":
                    node.names.append("#hidden")
                elif labelled and name == "data-y":
                    node.label = int(value)
            nodes.append(node)
            here = len(nodes) - 1
        if tag in RAW:
            if m[3].endswith("/") and tag in FOREIGN:
                continue
            end = _end_of(tag).search(page, at)
            if end or tag in UNCLOSED:
                at = end.end() if end else len(page)
                continue
        if tag in VOID or m[3].endswith("/") and not block:
            continue
        stack.append((tag, here))
        if tag == "a":
            anchors += 1
            nodes[here].links += 1
    close(1)
    end_run()
    for n in reversed(nodes):
        n.below += n.chars
        n.below_linked += n.linked
        if n.parent >= 0:
            nodes[n.parent].below += n.below
            nodes[n.parent].below_linked += n.below_linked
    for n in nodes:
        n.never = n.never or n.parent >= 0 and nodes[n.parent].never
    return nodes, runs


TAGS = tuple("#page html body article main section div p h1 h2 h3 h4 ul ol li table tr td th blockquote pre figure figcaption nav header footer aside form fieldset dl dt dd details summary address head".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_LEAF = frozenset("p li td th dt dd blockquote pre figcaption summary address".split())
KINDS = 3  # of children: containers, texts, headings


def kind(n: Node) -> int:
    return 2 if n.tag in _HEADING else 1 if n.tag in _LEAF else 0


def describe(nodes: list[Node], words: dict[str, int]) -> list[list[tuple[int, float]]]:
    """Sparse features of each node. ``words`` numbers the names known from training."""
    total = max(1, nodes[0].below)
    base = len(words)
    tag_at = {t: base + i for i, t in enumerate(TAGS)}
    f = base + len(TAGS) + 1
    out = []
    before = 0
    for n in nodes:
        x = [(f, 1.0), (tag_at.get(n.tag, base + len(TAGS)), 1.0)]
        x += [(words[w], 1.0) for w in dict.fromkeys(n.names) if w in words]
        if n.parent >= 0:
            p = nodes[n.parent]
            x += [(f + 1, 1.0 if p.tag in ("body", "html", "#page") else 0.0), (f + 14, 1.0 if p.tag in ("article", "main") else 0.0)]
        if n.chars:
            long = math.log1p(n.chars)
            x += [(f + 2, 1.0), (f + 3, long / 5), (f + 4, n.linked / n.chars), (f + 5, min(1.0, 20 * n.stops / n.chars)), (f + 6, 1.0 if n.chars < 25 else 0.0), (f + 7, 1.0 if n.chars > 120 else 0.0)]
        share = n.below / total
        x += [(f + 8, share), (f + 9, n.below_linked / max(1, n.below)), (f + 10, 1.0 if not n.below else 0.0), (f + 11, before / total), (f + 12, min(n.depth, 12) / 12), (f + 13, 1.0 if n.links and n.linked >= 0.6 * n.chars else 0.0)]
        before += n.chars
        out.append([(i, v) for i, v in x if v])
    return out


N_FIGURES = 15


@dataclass(frozen=True)
class Model:
    words: dict[str, int]
    weight: list[float]
    pair: list[list[float]]  # kind of child -> four log-potentials by 2 * parent + child


def _add(a: float, b: float) -> float:
    m = a if a > b else b
    return m + math.log1p(math.exp((a + b) - 2 * m))


def marginals(nodes: list[Node], unary: list[float], pair: list[list[float]]) -> tuple[list[float], list[tuple[float, float, float, float]], float]:
    """Sum-product on the tree: each node's probability of content, the pair probabilities with the parent, and log Z."""
    n = len(nodes)
    in0, in1 = [0.0] * n, list(unary)  # log of unary times messages from children
    up0, up1 = [0.0] * n, [0.0] * n
    for i in range(n - 1, 0, -1):
        p, t = nodes[i].parent, pair[kind(nodes[i])]
        a, b = in0[i], in1[i]
        up0[i], up1[i] = _add(t[0] + a, t[1] + b), _add(t[2] + a, t[3] + b)
        in0[p] += up0[i]
        in1[p] += up1[i]
    z = _add(in0[0], in1[0])
    one = [0.0] * n
    both = [(0.0, 0.0, 0.0, 0.0)] * n
    out0, out1 = [0.0] * n, [0.0] * n  # log of belief
    out0[0], out1[0] = in0[0], in1[0]
    one[0] = math.exp(in1[0] - z)
    for i in range(1, n):
        p, t = nodes[i].parent, pair[kind(nodes[i])]
        d0, d1 = out0[p] - up0[i], out1[p] - up1[i]
        q = (d0 + t[0] + in0[i], d0 + t[1] + in1[i], d1 + t[2] + in0[i], d1 + t[3] + in1[i])
        out0[i], out1[i] = _add(q[0], q[2]), _add(q[1], q[3])
        both[i] = tuple(math.exp(min(0.0, v - z)) for v in q)
        one[i] = math.exp(min(0.0, out1[i] - z))
    return one, both, z


def fit(pages: list[str], epochs: int = 12, rate: float = 0.05, ridge: float = 2e-4) -> Model:
    """Maximum likelihood on pages whose block elements carry their label in ``data-y``, by Adam on one page at a time."""
    parsed = [parse(p, labelled=True)[0] for p in pages]
    names: dict[str, int] = {}
    for nodes in parsed:
        for n in nodes:
            for w in n.names:
                names.setdefault(w, len(names))
    size = len(names) + len(TAGS) + 1 + N_FIGURES
    x = [describe(nodes, names) for nodes in parsed]
    y = []
    for nodes in parsed:
        for n in nodes:
            n.label = n.label if n.label is not None else nodes[n.parent].label if n.parent >= 0 else 0
        y.append([n.label for n in nodes])
    w, pair = np.zeros(size), np.zeros((KINDS, 4))
    m, v, mp, vp = np.zeros(size), np.zeros(size), np.zeros((KINDS, 4)), np.zeros((KINDS, 4))
    order, t = np.random.default_rng(5), 0
    for epoch in range(epochs):
        for k in order.permutation(len(parsed)):
            nodes, feats, labels = parsed[k], x[k], y[k]
            unary = [sum(w[i] * value for i, value in f) for f in feats]
            one, both, _ = marginals(nodes, unary, pair.tolist())
            g, gp = ridge * w, ridge * pair
            for i, f in enumerate(feats):
                d = one[i] - labels[i]
                for j, value in f:
                    g[j] += d * value / len(nodes)
                if i:
                    c = kind(nodes[i])
                    gp[c] += np.array(both[i]) / len(nodes)
                    gp[c, 2 * labels[nodes[i].parent] + labels[i]] -= 1 / len(nodes)
            t += 1
            step = rate / (1 + epoch / 3)
            for value, grad, a, b in ((w, g, m, v), (pair, gp, mp, vp)):
                a += 0.1 * (grad - a)
                b += 0.001 * (grad * grad - b)
                value -= step * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-6)
    return Model(names, w.tolist(), pair.tolist())


@lru_cache(maxsize=2)
def default_model(pages: int = 600, seed: int = 1) -> Model:
    """The model of the first ``pages`` labelled pages; the same in every process."""
    return fit(labelled_pages(pages, seed))


def main_text(page: str | None, model: Model) -> str:
    nodes, runs = parse(page)
    if not runs:
        return ""
    unary = [sum(model.weight[i] * value for i, value in f) for f in describe(nodes, model.words)]
    one, _, _ = marginals(nodes, unary, model.pair)
    return "\n".join(text for n, text in runs if one[n] > 0.5 and not nodes[n].never)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    A null or empty page, and one without content, gives an empty text. Pages of any length are read whole; a page that ends in a tag
    ends there. Rows are read one by one, so repeated ids do no harm. Other columns are ignored; an empty table gives no rows.
    """
    held = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), held.value) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
