"""HTML extraction: a tree-structured graphical model over the DOM.

Every block element, and every inline one that is hidden or named as an advert
or share link, is a variable: content or not.  Three kinds of factors:

* edge: parent's and child's label, given both elements' groups (``GROUPS``:
  chrome, main, paragraph, list, box);
* node: label and the element's own text (length and share of link text);
* root: not content.

Sum-product message passing, leaves to root and back, gives each node's exact
marginal; text whose element has a marginal of a half or more is the page's
text.

The factors are counted on labelled pages: pages whose markup names its main
element (``article``, ``main``, or such a class) label their own nodes.  A
bounded, documented number of pages (``MAX_TRAINING_PAGES``, by a hash of the
id) is used; the counts are summed by Spark, and the model is a table of fixed
size.  Smoothing makes an unseen pair of groups prefer equal labels, so that
text in unnamed boxes is decided by itself and its surroundings.

Blocks: a run of text without a block tag inside.  White space in it becomes
one space, ``br`` too; blocks are joined by one line feed in page order.  Text
of ``svg`` and ``math`` is text of the block around it.  What a browser does not
show (scripts, styles, the fallback inside ``video`` and its like) is not read.

Defined results: null or empty html, and html without content, give an empty
text; markup that is cut short is read as far as it goes; end tags without a
start are skipped; an unclosed element loses nothing that follows it, but for
``script`` and ``style``, which HTML lets run to the end of the page; pages of one id are each extracted; an empty table gives no
rows; further columns are left out.  No text is capped.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import maybe_broadcast, table
from ledgerlens.llm.features import slices

MAX_TRAINING_PAGES = 4_000

# HTML's elements by role, and words of class and id names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CODE = frozenset("script style".split())
RAW = frozenset("title textarea".split())
UNSHOWN = frozenset("template noscript iframe object canvas audio video desc metadata".split())
FOREIGN = frozenset("""math annotation menclose merror mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace
    msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics svg circle clippath defs ellipse g
    line lineargradient mask path polygon polyline radialgradient rect stop symbol text textpath tspan use""".split())
INLINE = FOREIGN | frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s
    samp small span strike strong sub sup time tt u var wbr""".split())
CHROME_TAGS = frozenset("""head nav header footer aside form menu dialog button select option fieldset legend label
    input""".split())
MAIN_TAGS = frozenset("article main".split())
PARAGRAPH_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())
LIST_TAGS = frozenset("ul ol li dl dt dd table thead tbody tfoot tr td th caption".split())
CHROME_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs
    comment comments consent cookie cookies disqus footer footnav form gdpr header login masthead menu menus modal nav
    navbar navigation newsletter notice notices overlay pager pagination popup privacy promo promoted promotion related
    replies reply respond search share sharing sidebar signup social sponsor sponsored sponsors subscribe subscription
    teaser toolbar topbar widget widgets""".split())
SET_OFF_WORDS = frozenset("ad ads adv advert adverts advertisement advertising promoted share sharing sponsored".split())
# Chrome only by itself or with one of the second kind; with a main word, a widget may be either.
RELATED, RELATED_TO = "related", frozenset("""article articles content items links news pages posts reading sidebar
    stories story topics""".split())
WIDGETS = frozenset("widget widgets".split())
MAIN_WORDS = frozenset("article articlebody body content entry main post story text".split())
CLOSES_P = PARAGRAPH_TAGS | LIST_TAGS - {"tr", "td", "th", "thead", "tbody", "tfoot", "caption"} | frozenset(
    "address article aside details div fieldset footer form header hr main menu nav section".split())
# A start tag of the key ends an open element of the values, up to the barrier.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
        "th": ({"td", "th"}, {"tr", "table"})}

GROUPS = ("box", "paragraph", "list", "main", "chrome")
BOX, PARAGRAPH, LIST, MAIN, CHROME = range(5)
# A quote opens a value only after an equals sign.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(?:[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:"[^"]*"|'[^']*')|[^>])*+)>?)""",
                 re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+").findall


@dataclass(slots=True)
class Node:
    parent: int
    tag: str
    group: int
    chars: int = 0       # of its own text
    linked: int = 0      # of it inside links


@dataclass(slots=True)
class Page:
    nodes: list[Node] = field(default_factory=list)
    blocks: list[list[tuple[int, str]]] = field(default_factory=list)  # pieces of text and their nodes


def name_words(attributes: str) -> tuple[list[set[str]], bool]:
    """The words of each name an element has, and whether it is hidden."""
    names: list[set[str]] = []
    hidden = False
    for name, value in ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role", "itemprop"):
            names += [{w.lower() for w in NAME_WORD(one)} for one in value.split()]
        elif name == "hidden" or (name, value) == ("aria-hidden", "true"):
            hidden = True
        elif name == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
    return names, hidden


def group_of(tag: str, attributes: str) -> int:
    """The group of a block element, by its tag and the words of its names."""
    if tag in ("html", "body"):
        return BOX
    names, hidden = name_words(attributes)
    words = set().union(*names)
    chrome = words & CHROME_WORDS
    if RELATED in chrome and not any(RELATED in n and (len(n) == 1 or n & RELATED_TO) for n in names):
        chrome.discard(RELATED)
    main = words & MAIN_WORDS
    if tag in CHROME_TAGS or hidden or chrome - WIDGETS or (chrome and not main):
        return CHROME
    if tag in MAIN_TAGS or (main and not chrome):
        return MAIN
    return PARAGRAPH if tag in PARAGRAPH_TAGS else LIST if tag in LIST_TAGS else BOX


def set_off(attributes: str) -> bool:
    """Whether an inline element is hidden or named as no part of its text."""
    names, hidden = name_words(attributes)
    return hidden or any(n & SET_OFF_WORDS for n in names)


def parse(source: str | None) -> Page:
    """The block elements of a page and its blocks of text."""
    page = Page([Node(-1, "#page", BOX)])
    nodes = page.nodes
    stack: list[tuple[str, int]] = [("#page", 0)]  # open elements and the block node each belongs to
    run: list[tuple[int, str]] = []
    links = 0

    def flush() -> None:
        if run:
            if any(text.strip() for _, text in run):
                page.blocks.append(run.copy())
            run.clear()

    def close(at: int) -> None:
        nonlocal links
        for tag, _ in stack[at:]:
            if tag not in INLINE:
                flush()
            links -= tag == "a"
        del stack[at:]

    def read(piece: str) -> None:
        if piece:
            text = html.unescape(piece)
            run.append((stack[-1][1], text))
            size = len(text) - text.count(" ")
            nodes[stack[-1][1]].chars += size
            if links:
                nodes[stack[-1][1]].linked += size

    source, at = source or "", 0
    while True:
        m = TAG.search(source, at)
        if m is None:
            read(source[at:])
            break
        read(source[at:m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
            continue
        if tag in CODE or tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, at)
            if end is None and tag in RAW:  # its text goes up to the next tag
                end = re.compile(r"(?=<)").search(source, at)
            at = end.end() if end else len(source)
            continue
        if tag in UNSHOWN:
            end = None if m[0].endswith("/>") else re.compile(rf"<(/?){tag}\b[^>]*>?", re.I).search(source, at)
            if end and end[1]:  # closed before another one begins
                at = end.end()
            continue
        if tag == "br":
            run.append((stack[-1][1], " "))
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        if tag in ENDS:
            ended, barrier = ENDS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in barrier:
                    break
                if stack[i][0] in ended:
                    close(i)
                    break
        if tag in VOID or (tag in FOREIGN and m[0].endswith("/>")):
            if tag not in INLINE:
                flush()
            continue
        if tag in INLINE:
            links += tag == "a"
            if m[3] and set_off(m[3]):
                nodes.append(Node(stack[-1][1], tag, CHROME))
                stack.append((tag, len(nodes) - 1))
            else:
                stack.append((tag, stack[-1][1]))
        else:
            flush()
            nodes.append(Node(stack[-1][1], tag, group_of(tag, m[3])))
            stack.append((tag, len(nodes) - 1))
    flush()
    return page


def look(node: Node) -> str:
    """The node's own text as one category: length and share of link text."""
    if not node.chars:
        return "empty"
    share = node.linked / node.chars
    size = sum(node.chars >= x for x in (20, 80, 250))
    return f"{size}{'none' if share == 0 else 'some' if share < 0.5 else 'most'}"


def labels(page: Page) -> list[int] | None:
    """A page's own labels: content is what lies in its main element, and not
    in chrome; None if the page marks none."""
    out: list[int] = []
    shut: list[bool] = []  # inside chrome
    for node in page.nodes:
        inside = node.parent >= 0 and shut[node.parent]
        shut.append(inside or node.group == CHROME)
        above = node.parent >= 0 and out[node.parent]
        out.append(int(not shut[-1] and (node.group == MAIN or above)))
    return out if any(out) else None


@dataclass(frozen=True)
class Factors:
    """Log factors: ``edge[parent group, child group, parent label, child
    label]`` and, by category, the log odds of content."""

    edge: np.ndarray
    odds: dict[str, float]


SAME, OTHER = 3.0, 1.0    # smoothing counts of equal and unequal labels on an edge
BACKOFF = 1000.0          # weight of what is known of a named group alone, with any neighbour
ODDS_LIMIT = 4.0          # one node's text never outweighs a well-counted edge


def estimate(counts: dict[str, float]) -> Factors:
    """Factors from counts by key ``edge|gp|gc|yp|yc`` and ``look|category|y``."""
    seen = np.zeros((5, 5, 2, 2))
    looks: dict[str, list[float]] = {}
    for key, n in counts.items():
        kind, *rest = key.split("|")
        if kind == "edge":
            gp, gc, yp, yc = map(int, rest)
            seen[gp, gc, yp, yc] += n
        else:
            looks.setdefault(rest[0], [1.0, 1.0])[int(rest[1])] += n
    edge = np.full((5, 5, 2, 2), OTHER)
    edge[:, :, 0, 0] = edge[:, :, 1, 1] = SAME
    for group in (MAIN, CHROME):
        # a named child's label whatever its parent; a named parent's children whatever they are
        child = seen[:, group].sum(axis=(0, 1)) + OTHER
        below = seen[group].sum(axis=0) + OTHER
        for other in range(5):
            if not (group == MAIN and other == CHROME):  # what chrome holds is chrome
                edge[other, group] += BACKOFF * child / child.sum()
                if not (group == MAIN and other == MAIN):
                    edge[group, other] += BACKOFF * below / below.sum(axis=1, keepdims=True)
    edge += seen
    edge /= edge.sum(axis=3, keepdims=True)
    total = np.sum(list(looks.values()), axis=0) if looks else np.ones(2)
    odds = {c: max(-ODDS_LIMIT, min(ODDS_LIMIT, math.log(n[1] / total[1]) - math.log(n[0] / total[0])))
            for c, n in looks.items()}
    odds["empty"] = 0.0
    return Factors(np.log(edge), odds)


def count(page: Page) -> Counter:
    out: Counter = Counter()
    y = labels(page)
    if y is None:
        return out
    for node, label in zip(page.nodes, y):
        if node.tag not in ("#page", "html", "body"):
            out[f"edge|{page.nodes[node.parent].group}|{node.group}|{y[node.parent]}|{label}"] += 1
        if node.chars:
            out[f"look|{look(node)}|{label}"] += 1
    return out


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    hi, lo = (a, b) if a > b else (b, a)
    return hi + math.log1p(math.exp(lo - hi))


def marginals(page: Page, factors: Factors) -> list[float]:
    """P(content) of each node by sum-product, upward and downward."""
    nodes, edge = page.nodes, factors.edge
    n = len(nodes)
    own = [(0.0, factors.odds.get(look(x), 0.0)) for x in nodes]
    own[0] = (0.0, -30.0)
    up = [list(o) for o in own]               # own factor and the messages of all children
    sent = [(0.0, 0.0)] * n                   # message to the parent
    tables = [edge[nodes[x.parent].group, x.group].tolist() if x.parent >= 0 else None for x in nodes]
    for i in range(n - 1, 0, -1):             # children come after their parents
        t, (a, b) = tables[i], up[i]
        m = (_add(t[0][0] + a, t[0][1] + b), _add(t[1][0] + a, t[1][1] + b))
        top = max(m)
        sent[i] = (m[0] - top, m[1] - top)
        p = up[nodes[i].parent]
        p[0] += sent[i][0]
        p[1] += sent[i][1]
    belief = [tuple(u) for u in up]
    for i in range(1, n):
        p, t = belief[nodes[i].parent], tables[i]
        rest = (p[0] - sent[i][0], p[1] - sent[i][1])
        down = (_add(t[0][0] + rest[0], t[1][0] + rest[1]), _add(t[0][1] + rest[0], t[1][1] + rest[1]))
        b = (up[i][0] + down[0], up[i][1] + down[1])
        top = max(b)
        belief[i] = (b[0] - top, b[1] - top)
    return [1.0 / (1.0 + math.exp(max(-60.0, min(60.0, a - b)))) for a, b in belief]


def main_text(source: str | None, factors: Factors) -> str:
    page = parse(source)
    p = marginals(page, factors)
    texts = (" ".join("".join(text for i, text in block if p[i] >= 0.5).split()) for block in page.blocks)
    return "\n".join(text for text in texts if text)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for part in slices(batches, "html"):
        for source in part.column("html").to_pylist():
            total.update(count(parse(source)))
    yield pa.RecordBatch.from_pydict({"key": pa.array(list(total), pa.string()),
                                      "n": pa.array([float(x) for x in total.values()], pa.float64())})


def train(pages: DataFrame, limit: int = MAX_TRAINING_PAGES) -> Factors:
    """Factors from at most ``limit`` of ``pages``, those of least hash of id.
    The counts have a bounded number of keys: pairs of groups and labels, and
    text categories."""
    ids = (pages.select(F.col("page_id").cast("long").alias("chosen")).filter("chosen is not null").distinct()
           .orderBy(F.xxhash64("chosen"), "chosen").limit(limit))
    sample = pages.select(F.col("page_id").cast("long").alias("id"), F.col("html").cast("string").alias("html"))
    small = maybe_broadcast(ids)
    counts = (sample.join(small, sample["id"] == small["chosen"], "left_semi").select("html")
              .mapInArrow(_count, "key string, n double").groupBy("key").agg(F.sum("n").alias("n")))
    return estimate({r["key"]: r["n"] for r in counts.collect()})


def extract(pages: DataFrame, factors: Factors) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page."""
    sent = pages.sparkSession.sparkContext.broadcast(factors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for part in slices(batches, "html"):
            texts = [main_text(x, model) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_dom_sum_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages))
