"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks with the elements that hold them.  A logistic classifier gives
each block, from its text alone (length, share of links, sentence end, heading, place on the page),
a cost of being called content and one of being called boilerplate: its capacities from source and
to sink.  What tags, roles and names say is not said of blocks but of the containers that carry
them: each is a node with capacities of its own, in proportion to the blocks it holds.  DOM
proximity and adjacency are the smoothness edges: a block is joined to its nearest such container,
a container to the one around it, and blocks to their neighbours and siblings.  The minimum cut
decides: it carries a container's evidence to blocks whose text says otherwise, and where a page
has no such containers it settles blocks by their neighbours.

Learning: blocks inside article or main are examples of content, those inside nav, footer, aside
and the like of boilerplate; the classifier is fitted to at most FIT_BLOCKS of the blocks of about
SAMPLE_PAGES pages, chosen by hash.  Without examples the weights are DEFAULT.

The cut: a node whose own capacity is no less than its edges' together is settled at once, and its
edges become capacities of its neighbours; what is left after that is solved by max-flow in phases
(Dinic's algorithm), so a page of tens of thousands of blocks takes seconds.

Defined results: null or empty html: empty text; a page cut off anywhere is read to its end;
unclosed elements close as in HTML (a block ends an open paragraph, button or list); what stands
in an unclosed script or style is not text; character references without a semicolon are decoded
where HTML does; repeated rows: repeated results; very long pages are read whole; an empty table:
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|</?[a-zA-Z!?][^>]*(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"\b(class|id|role|style|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

# Elements that end a block.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SINGLE = frozenset("hr br img input meta link area base col embed source track wbr".split())
#: An element of the left closes an open one of the right.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

# What elements, roles and names say about the blocks inside.
BOILER_TAGS = frozenset("nav footer aside form head title dialog menu fieldset legend button select".split())
CONTENT_TAGS = frozenset("article main".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog toolbar form note".split())
CONTENT_ROLES = frozenset("main article".split())
BOILER_NAMES = re.compile(
    r"(?:^|(?<!\bhas)(?<!\bwith)(?<!\bno)[\s_-])(?:nav|navbar|navigation|menu|menus|footer|foot|header|masthead|topbar|sidebar|side|aside|ad|ads|adv|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|gdpr|notice|notices|alert|notification|comment|comments|reply|replies|respond|disqus|share|sharing|social|related|recommended|breadcrumb|breadcrumbs|newsletter|subscribe|subscription|signup|login|popup|modal|overlay|widget|pager|pagination|tags|toolbar|copyright|legal|disclaimer|search)(?:$|[\s_-]|\d)",
    re.I,
)
CONTENT_NAMES = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|main|maintext|articlebody|post-body|entry-content)(?:$|[\s_-]|\d)", re.I)

#: Elements whose inside is not text of the page: to their end tag; without one, to the page's end (RAW) or nothing.
RAW = frozenset("script style noscript template iframe textarea".split())
EMBEDDED = frozenset("object svg math canvas audio video".split())
_END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in RAW | EMBEDDED}

#: Evidence of a container, a block that it holds, and the capacity of its edge to each of them.
CONTENT, NAMED_CONTENT, BOILER, NAMED_BOILER = (6.0, 6.0), (2.5, 3.0), (-6.0, 6.0), (-4.0, 4.0)
#: The page around all containers, with and without an article or main element.
AROUND_CONTENT, AROUND_NOTHING = (-3.0, 3.0), (0.0, 0.3)
#: A header inside an article: what its headings and its other blocks say, and its edge to them.
HEADER_HEADING, HEADER_OTHER, HEADER_EDGE = 4.0, -5.0, 0.6
#: Edges: between a container and the one around it; between neighbours, and between siblings, at no distance in the DOM.
AROUND, ADJACENT, SIBLING = 2.0, 0.6, 0.6
#: A block's own logit is at most this.
OWN = 2.5
#: Weights of bias, length, share of links, sentence end, heading, distance from the page's middle.
DEFAULT = (-0.5, 2.0, -3.0, 0.5, 0.5, -0.5)
SAMPLE_PAGES, FIT_BLOCKS, RIDGE = 2_000, 50_000, 30.0

_NONE, _CONTENT, _NAMED, _BOILER, _BOILER_NAME, _HEADER = range(6)
_SAYS = {_CONTENT: CONTENT, _NAMED: NAMED_CONTENT, _BOILER: BOILER, _BOILER_NAME: NAMED_BOILER, _HEADER: (0.0, HEADER_EDGE)}


class Block:
    __slots__ = ("text", "heading", "linked", "depth", "parent", "inside", "content")

    def __init__(self, text, heading, linked, depth, parent, inside):
        self.text, self.heading, self.linked, self.depth, self.parent, self.inside = text, heading, linked, depth, parent, inside
        self.content = False


class Page:
    """The blocks, and the containers that say something: their kind and the container around each."""

    __slots__ = ("blocks", "kinds", "around")

    def __init__(self):
        self.blocks: list[Block] = []
        self.kinds, self.around = [_NONE], [-1]


def _kind(tag: str, attrs: str, above: int, in_article: bool) -> int:
    """What an element says of what it holds; _NONE: nothing that its surroundings don't say."""
    if above == _BOILER:
        return _NONE
    if tag in BOILER_TAGS:
        return _BOILER
    if tag in CONTENT_TAGS:
        return _CONTENT
    if tag == "header":
        return _HEADER if in_article else _BOILER
    found = _NONE
    if attrs and "=" in attrs or "hidden" in attrs:
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return _BOILER
            if name == "role":
                if value.lower() in BOILER_ROLES:
                    return _BOILER
                if value.lower() in CONTENT_ROLES:
                    found = _CONTENT
            elif name in ("class", "id") and tag not in ("body", "html") and above != _BOILER_NAME and found != _CONTENT:
                if BOILER_NAMES.search(value):
                    found = _BOILER_NAME
                elif CONTENT_NAMES.search(value) and found == _NONE and above not in (_CONTENT, _HEADER):
                    found = _NAMED
    return found


def read(html: str) -> Page:
    page = Page()
    out, kinds, around = page.blocks, page.kinds, page.around
    stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]  # tag, container, number, inside an article
    text: list[str] = []
    endless: set[str] = set()
    linked = links = number = at = 0

    def flush():
        nonlocal linked
        if text:
            raw = "".join(text)
            text.clear()
            said = " ".join((unescape(raw) if "&" in raw else raw).split())
            if said:
                tag, inside, own, _ = stack[-1]
                parent = stack[-2][2] if tag in ("p", "li", "td", "th") and len(stack) > 1 or tag in _HEADINGS else own
                out.append(Block(said, any(s[0] in _HEADINGS for s in stack[-2:]), min(1.0, linked / len(raw)), len(stack), parent, inside))
        linked = 0

    while m := _TOKEN.search(html, at):
        if m.start() > at:
            piece = html[at : m.start()]
            text.append(piece)
            if links:
                linked += len(piece)
        at = m.end()
        if m[2] is None:
            continue
        tag, ends = m[2].lower(), bool(m[1])
        if tag in _END:
            if not ends and tag not in endless and not (tag in ("svg", "math") and m[0].endswith("/>")):
                end = _END[tag].search(html, at)
                if end:
                    at = end.end()
                elif tag in RAW:
                    at = len(html)
                else:
                    endless.add(tag)
            continue
        if tag not in BLOCKS:
            if tag == "a":
                links = 0 if ends else 1
            elif tag in _SINGLE:
                text.append(" ")
            continue
        flush()
        links = 0
        if ends:
            if any(s[0] == tag for s in stack):
                while stack.pop()[0] != tag:
                    pass
            continue
        if stack[-1][0] == "p" or stack[-1][0] in _HEADINGS and tag in _HEADINGS or stack[-1][0] == "button" or stack[-1][0] == "select" and tag not in ("option", "optgroup"):
            stack.pop()
        elif tag in _CLOSES and stack[-1][0] in _CLOSES[tag]:
            while stack[-1][0] in _CLOSES[tag]:
                stack.pop()
        if tag == "body":  # a head that was never closed ends here
            while len(stack) > 1 and stack[-1][0] != "html":
                stack.pop()
        if tag in _SINGLE:
            continue
        number += 1
        _, inside, _, in_article = stack[-1]
        kind = _kind(tag, m[3] or "", kinds[inside], in_article)
        if kind != _NONE:
            kinds.append(kind), around.append(inside)
            inside = len(kinds) - 1
        stack.append((tag, inside, number, in_article or tag in CONTENT_TAGS))
    if at < len(html):
        text.append(html[at:])
        if links:
            linked += len(html) - at
    flush()
    return page


def features(found: list[Block]) -> np.ndarray:
    out = np.ones((len(found), len(DEFAULT)))
    for i, b in enumerate(found):
        out[i, 1:5] = min(b.text.count(" ") + 1, 20) / 20, b.linked, b.text[-1] in ".!?…\"'”»", b.heading
    out[:, 5] = np.abs(2 * (np.arange(len(found)) + 0.5) / max(1, len(found)) - 1)
    return out


def min_cut(logits: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut.

    A node's logit is its capacity from the source (positive) or to the sink (negative).
    """
    n = len(logits)
    left, near = list(logits), [[] for _ in range(n)]
    to, cap = [], []
    for a, b, c in edges:
        near[a].append(len(to)), to.append(b), cap.append(c)
        near[b].append(len(to)), to.append(a), cap.append(c)
    # Nodes that outweigh their edges are settled, and then perhaps their neighbours.
    held = [sum(cap[e] for e in arcs) for arcs in near]
    side: list[bool | None] = [None] * n
    queue = list(range(n))
    while queue:
        a = queue.pop()
        if side[a] is not None or abs(left[a]) < held[a] - 1e-12:
            continue
        side[a] = left[a] > 0
        for e in near[a]:
            b = to[e]
            if side[b] is None:
                left[b] += cap[e] if side[a] else -cap[e]
                held[b] -= cap[e]
                queue.append(b)
    rest = [i for i in range(n) if side[i] is None]
    near = [[e for e in arcs if side[to[e]] is None] if side[i] is None else [] for i, arcs in enumerate(near)]
    while True:
        # Levels by distance from nodes with something left, as far as the nearest that can take it.
        level = dict.fromkeys((i for i in rest if left[i] > 1e-12), 0)
        layer, reached = list(level), False
        while layer and not reached:
            nxt = []
            for a in layer:
                for e in near[a]:
                    b = to[e]
                    if cap[e] > 1e-12 and b not in level:
                        level[b] = level[a] + 1
                        nxt.append(b)
                        reached |= left[b] < -1e-12
            layer = nxt
        if not reached:
            for i in rest:
                side[i] = i in level
            return side
        arc = dict.fromkeys(level, 0)
        for start in [i for i, d in level.items() if not d]:
            path, a = [], start
            while left[start] > 1e-12:
                if left[a] < -1e-12:
                    flow = min(left[start], -left[a], *(cap[e] for e in path))
                    left[start] -= flow
                    left[a] += flow
                    for e in path:
                        cap[e] -= flow
                        cap[e ^ 1] += flow
                    path, a = [], start
                    continue
                arcs, k = near[a], arc[a]
                while k < len(arcs) and not (cap[arcs[k]] > 1e-12 and level.get(to[arcs[k]]) == level[a] + 1):
                    k += 1
                arc[a] = k
                if k < len(arcs):
                    path.append(arcs[k])
                    a = to[arcs[k]]
                elif path:
                    a = to[path.pop() ^ 1]
                    arc[a] += 1
                else:
                    break


def label(page: Page, weights=DEFAULT, smooth: float = 1.0) -> None:
    """Set each block's content; smooth scales all smoothness edges."""
    found = page.blocks
    if not found:
        return
    own = np.clip(features(found) @ np.asarray(weights), -OWN, OWN).tolist()
    n, edges, last = len(found), [], {}
    around = AROUND_CONTENT if _CONTENT in page.kinds else AROUND_NOTHING
    says = [around if k == _NONE else _SAYS[k] for k in page.kinds]
    holds = [0] * len(says)
    for i, b in enumerate(found):
        holds[b.inside] += 1
        if page.kinds[b.inside] == _HEADER:
            own[i] = HEADER_HEADING if b.heading else HEADER_OTHER
        edges.append((i, n + b.inside, smooth * says[b.inside][1]))
        if i:
            far = abs(found[i - 1].depth - b.depth) + 2 * (found[i - 1].parent != b.parent)
            edges.append((i - 1, i, smooth * ADJACENT / (1 + far)))
        if b.parent in last:
            edges.append((last[b.parent], i, smooth * SIBLING / (i - last[b.parent])))
        last[b.parent] = i
    edges += [(n + i, n + a, smooth * AROUND) for i, a in enumerate(page.around) if a >= 0]
    logits = own + [says[i][0] * max(1, holds[i]) for i in range(len(says))]
    for b, side in zip(found, min_cut(logits, edges), strict=False):
        b.content = side


def main_text(html: str | None, weights=DEFAULT) -> str:
    if not html:
        return ""
    page = read(html)
    label(page, weights)
    return "\n\n".join(b.text for b in page.blocks if b.content)


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton steps with a ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), x.T @ (y - p) - RIDGE * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(pages: DataFrame) -> tuple[float, ...]:
    """The classifier's weights from the blocks whose containers' tags tell what they are."""
    every = max(1, math.ceil(pages.count() / SAMPLE_PAGES))
    sample = pages.where(F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(every)) == 0).select(F.col("html").cast("string").alias("html"))

    def examples(batches):
        for batch in batches:
            for html in batch.column(0):
                page = read(html.as_py() or "")
                known = [page.kinds[b.inside] in (_CONTENT, _BOILER) for b in page.blocks]
                x = features(page.blocks)[known]
                y = [page.kinds[b.inside] == _CONTENT for b, k in zip(page.blocks, known, strict=True) if k]
                yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(y, pa.bool_())], ["x", "y"])

    rows = sample.mapInArrow(examples, "x array<double>, y boolean").orderBy(F.xxhash64("x", "y"), "x").limit(FIT_BLOCKS).toArrow()
    y = np.array(rows.column(1).to_pylist(), float)
    if not 0 < y.sum() < len(y):
        return DEFAULT
    return tuple(fit(np.array(rows.column(0).to_pylist()), y).tolist())


def extract(pages: DataFrame, weights=None) -> DataFrame:
    """(page_id, url, text, n_blocks, n_content) of each row of pages (page_id, url, html)."""
    weights = learn(pages) if weights is None else tuple(weights)

    def run(batches):
        for batch in batches:
            texts, total, kept = [], [], []
            for html in batch.column(2):
                page = read(html.as_py() or "")
                label(page, weights)
                own = [b.text for b in page.blocks if b.content]
                texts.append("\n\n".join(own)), total.append(len(page.blocks)), kept.append(len(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(total, pa.int32()), pa.array(kept, pa.int32())], ["page_id", "url", "text", "n_blocks", "n_content"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_blocks int, n_content int")


def op9(spark, sf_dir):
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_content")


QUERIES = {"op9_min_cut_text": op9}
ORACLE: dict[str, str] = {}
