"""Main text of web pages by minimum-cut labelling of text blocks.

A page is read into blocks of text in page order.  A classifier gives each block a cost for being
called content and one for being called boilerplate; the two become its capacities to the sink and
from the source.  Blocks that follow each other, and blocks with the same parent element, are joined
by smoothness edges whose capacity falls with their distance in the element tree.  The maximum flow
then separates content from boilerplate at the least total cost.

The classifier adds up the markup's evidence (names of elements, classes, ids and roles, the nearest
one deciding) and a logistic model of the block's text, which is trained on blocks whose markup
leaves no doubt."""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftlake.llm.common import ship

SAMPLE_PAGES = 2_000  # about as many pages, chosen by hash, train the text model
SMOOTH = 1.0  # capacity between neighbours with one parent
FAR = 16  # tree distances are told apart up to here
TEXT_WEIGHT = 2.0  # the most that the text alone can say
SURE, KIND, LAYOUT = -8.0, -2.5, -2.25  # boilerplate by element or role, by a class that names the text, by one that names its place

# Names of elements, roles and classes and what they say about a block.
SILENT = frozenset("head title script style noscript template iframe object svg math canvas audio video map "
                   "select option datalist textarea button progress meter".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr img input".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar "
                         "toolbar tablist".split())
BOILER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices alert popup modal overlay sidebar rail widget widgets nav navbar navigation menu menus "
    "breadcrumb breadcrumbs footer header masthead topbar share sharing social related recommended recommendations "
    "newsletter subscribe subscription signup login search pagination pager toolbar skip legal copyright disclaimer "
    "comment comments commentlist reply replies discussion disqus respond form side topnav sidenav subnav".split())
COMMENT_NAMES = frozenset("comment comments commentlist reply replies discussion disqus respond".split())
LAYOUT_NAMES = frozenset("sidebar side rail form header masthead banner topbar search login signup".split())
PLACES = frozenset("site page main top bottom global primary secondary left right user reader post entry article blog "
                   "web app".split())
CONTENT_NAMES = frozenset("content article post entry story body text main".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
_NAME = re.compile(r"[^\s]+")


def _boiler_says(name: str) -> float:
    return SURE if name in COMMENT_NAMES else LAYOUT if name in LAYOUT_NAMES else KIND


def _name_says(name: str) -> float:
    """What one class or id says: below 0 boilerplate, 2 content, 0 nothing."""
    parts = [p for p in re.split(r"[-_]+", name.lower()) if p]
    if not parts:
        return 0.0
    if parts[0] in BOILER_NAMES:
        return _boiler_says(parts[0])
    if len(parts) > 1 and parts[0] in PLACES and parts[-1] in BOILER_NAMES:
        return 0.0 if parts[-1] == "header" and parts[0] in ("post", "entry", "article") else _boiler_says(parts[-1])
    return 2.0 if parts[0] in CONTENT_NAMES or parts[-1] in CONTENT_NAMES else 0.0


def _evidence(tag: str, attrs: dict, in_article: bool) -> float:
    """What an element says about the text in it.  What is below 0 holds for all below it, as ``_below`` says."""
    role = (attrs.get("role") or "").lower()
    style = (attrs.get("style") or "").lower().replace(" ", "")
    hidden = "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or "display:none" in style
    if hidden or (tag in BOILER_TAGS and tag != "form") or role in BOILER_ROLES or (tag == "header" and not in_article):
        return SURE
    said = [0.0]
    if tag not in ("html", "body", "main"):
        said += [_name_says(n) for key in ("class", "id") for n in _NAME.findall(attrs.get(key) or "")]
    if tag == "form":
        said.append(LAYOUT)
    if min(said) < 0:
        return min(said)
    if max(said) > 0 and tag != "article":
        return 2.0
    return 4.0 if tag in ("article", "main") or role in ("main", "article") else 0.0


def _below(above: float, own: float, tag: str, role: str, form: bool) -> float:
    """What holds in an element that says ``own``, where its parent's ``above`` holds.  A verdict of
    boilerplate stays unless a worse one is met; that of a place ends at an article or main element,
    that of a form also at a class for content, that of a kind of text at a main element only."""
    if above >= 0:
        return own or above
    if own < 0:
        return min(above, own)
    main = tag == "main" or role == "main"
    if (above == LAYOUT and (own == 4.0 or (form and own > 0))) or (above == KIND and main and own > 0):
        return own
    return above


class Block:
    """A run of text without a block boundary."""

    __slots__ = ("pieces", "linked", "evidence", "parent", "depth", "heading", "layouts")

    def __init__(self, evidence: float, parent: int, depth: int, heading: bool, layouts: tuple = ()):
        self.pieces: list[str] = []
        self.linked = 0
        self.evidence, self.parent, self.depth, self.heading = evidence, parent, depth, heading
        self.layouts = layouts  # the elements around it that LAYOUT comes from

    @property
    def text(self) -> str:
        return " ".join("".join(self.pieces).split())


class _Reader(HTMLParser):
    """Blocks in page order and the parent of every element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.parents, self.depths = [-1], [0]
        # tag, element, evidence, elements of layout around, all of them forms, silent, in article
        self.stack: list[tuple] = [("", 0, 0.0, (), True, False, False)]
        self.block: Block | None = None
        self.links = 0

    def _end_block(self) -> None:
        if self.block is not None and self.block.text:
            self.blocks.append(self.block)
        self.block = None

    def _pop(self, until: int) -> None:
        while len(self.stack) > until:
            tag, *_ = self.stack.pop()
            if tag == "a":
                self.links -= 1

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag in ("br", "hr"):
                self._end_block()
            return
        if tag in CLOSES:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i][0] in CLOSES[tag]:
                    self._end_block()
                    self._pop(i)
                    break
                if self.stack[i][0] in STOPS.get(tag, ()) or (tag == "p" and self.stack[i][0] not in INLINE):
                    break
        _, above, before, layouts, forms, silent, in_article = self.stack[-1]
        attrs = dict(attrs)
        own = _evidence(tag, attrs, in_article) if before > SURE else 0.0
        evidence = _below(before, own, tag, (attrs.get("role") or "").lower(), forms)
        if tag not in INLINE or evidence != before:
            self._end_block()
            self.parents.append(above)
            self.depths.append(self.depths[above] + 1)
            above = len(self.parents) - 1
        if tag == "a":
            self.links += 1
        if evidence != LAYOUT:
            layouts, forms = (), True
        elif own == LAYOUT:
            layouts, forms = (*layouts, above), forms and tag == "form"
        self.stack.append((tag, above, evidence, layouts, forms, silent or tag in SILENT,
                           in_article or tag in ("article", "main")))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in SILENT:  # a slash does not close other elements
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                if any(t[0] not in INLINE for t in self.stack[i:]) or self.stack[i][2] != self.stack[i - 1][2]:
                    self._end_block()
                self._pop(i)
                return
        if tag in ("p", "br"):
            self._end_block()

    def handle_data(self, data):
        _, element, evidence, layouts, _, silent, _ = self.stack[-1]
        if silent:
            return
        if self.block is None:
            if not data.strip():
                return
            heading = any(t[0] in ("h1", "h2", "h3", "h4", "h5", "h6") for t in self.stack[-4:])
            self.block = Block(evidence, element, self.depths[element], heading, layouts)
        self.block.pieces.append(data)
        if self.links:
            self.block.linked += len(data.strip())


def _lift(blocks: list[Block], parents: list[int]) -> None:
    """A layout element that holds most of a page's words, and without which nothing on the page is
    marked as content, is a wrapper and says nothing."""
    candidates = {e for b in blocks for e in b.layouts}
    if not candidates:
        return
    inside, marked = dict.fromkeys(candidates, 0), dict.fromkeys(candidates, 0)
    words, content = 0, 0
    for b in blocks:
        if b.evidence <= KIND:
            continue
        n, e = len(b.text.split()), b.parent
        words, content = words + n, content + (b.evidence > 0)
        while e >= 0:
            if e in inside:
                inside[e] += n
                marked[e] += b.evidence > 0
            e = parents[e]
    wrappers = {e for e in candidates if 2 * inside[e] > words and marked[e] == content}
    for b in blocks:
        if b.layouts and wrappers.issuperset(b.layouts):
            b.evidence = 0.0


def read_blocks(html: str | None) -> tuple[list[Block], list[int], list[int]]:
    """Blocks, and parent and depth of every element."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader._end_block()
    _lift(reader.blocks, reader.parents)
    return reader.blocks, reader.parents, reader.depths


def text_features(block: Block) -> list[float]:
    text = block.text
    words = text.split()
    ends = sum(text.count(c) for c in ".!?…")
    return [1.0, math.log1p(len(words)), min(1.0, block.linked / max(1, len(text))), ends / max(1, len(words)),
            float(text[-1:] in ".!?…\"”"), float(block.heading), sum(w[:1].isupper() for w in words) / max(1, len(words)),
            math.log1p(block.depth)]


#: Weights of ``text_features`` where no model can be trained: text is content, the more so the longer,
#: unless it is mostly links.
UNTRAINED = [0.1, 0.45, -3.0, 0.0, 0.2, 0.0, 0.0, 0.0]


def _distance(a: int, b: int, parents: list[int], depths: list[int]) -> int:
    steps = 0
    while a != b and steps < FAR:
        if depths[a] < depths[b]:
            a, b = b, a
        a = parents[a]
        steps += 1
    return steps


def edges_of(blocks: list[Block], parents: list[int], depths: list[int]) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours on the page, and successive blocks of the same grandparent."""
    out, last = [], {}
    for i, block in enumerate(blocks):
        if i:
            out.append((i - 1, i, SMOOTH / (1 + _distance(blocks[i - 1].parent, block.parent, parents, depths))))
        above = max(parents[block.parent], 0)
        if above in last and last[above] < i - 1:
            out.append((last[above], i, SMOOTH / 2))
        last[above] = i
    return out


def min_cut(balance: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source.  ``balance``: capacity from the source, or to the sink if
    negative.  Nodes whose own capacity outweighs all their edges are settled first, which moves
    their edges to the neighbours' balance; the rest goes through Dinic's maximum flow."""
    n, balance = len(balance), list(balance)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for u, v, c in edges:
        near[u][v] = near[u].get(v, 0.0) + c
        near[v][u] = near[v].get(u, 0.0) + c
    weight = [sum(x.values()) for x in near]
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        u = todo.popleft()
        if side[u] is None and abs(balance[u]) > weight[u]:
            side[u] = balance[u] > 0
            for v, c in near[u].items():
                if side[v] is None:
                    balance[v] += c if side[u] else -c
                    weight[v] -= c
                    todo.append(v)
    rest = [u for u in range(n) if side[u] is None]
    if rest:
        place = {u: i for i, u in enumerate(rest)}
        left = [(place[u], place[v], c) for u in rest for v, c in near[u].items() if u < v and v in place]
        for u, inside in zip(rest, _max_flow([balance[u] for u in rest], left)):
            side[u] = inside
    return [bool(x) for x in side]


def _max_flow(balance: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Dinic: level graphs by breadth-first search, blocking flows along them."""
    n = len(balance)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to, cap = [], []

    def add(u: int, v: int, c: float, back: float) -> None:
        head[u].append(len(to))
        to.append(v)
        cap.append(c)
        head[v].append(len(to))
        to.append(u)
        cap.append(back)

    for u, b in enumerate(balance):
        if b > 0:
            add(source, u, b, 0.0)
        elif b < 0:
            add(u, sink, -b, 0.0)
    for u, v, c in edges:
        add(u, v, c, c)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in head[u]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[u] >= 0 for u in range(n)]
        arc, path = [0] * (n + 2), []
        u = source
        while True:
            if u == sink:
                amount = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= amount
                    cap[e ^ 1] += amount
                cut = next(i for i, e in enumerate(path) if cap[e] <= tiny)
                u = to[path[cut] ^ 1]
                del path[cut:]
            elif arc[u] < len(head[u]):
                e = head[u][arc[u]]
                if cap[e] > tiny and level[to[e]] == level[u] + 1:
                    path.append(e)
                    u = to[e]
                else:
                    arc[u] += 1
            elif path:
                level[u] = -1
                u = to[path.pop() ^ 1]
                arc[u] += 1
            else:
                break


def main_text(html: str | None, weights: list[float]) -> str:
    blocks, parents, depths = read_blocks(html)
    if not blocks:
        return ""
    w = np.asarray(weights or UNTRAINED)
    balance = []
    for block in blocks:
        says = float(np.clip(np.dot(w, text_features(block)), -TEXT_WEIGHT, TEXT_WEIGHT))
        balance.append(block.evidence + says)
    inside = min_cut(balance, edges_of(blocks, parents, depths))
    return "\n".join(b.text for b, keep in zip(blocks, inside) if keep)


def fit_text_model(pages: DataFrame, id_col: str = "page_id", html: str = "html", sample: int = SAMPLE_PAGES) -> list[float]:
    """Logistic weights of ``text_features``, from the blocks of a sample of pages chosen by hash, whose markup
    says content or boilerplate.  Both classes count alike.  Without one of them there are no weights, and UNTRAINED stands in."""
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(html).cast("string").alias("html"))
    share = min(1.0, sample / max(1, rows.count()))
    chosen = rows.where(F.pmod(F.xxhash64(F.lit("pages"), "id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for page in batch["html"]:
                for block in read_blocks(page)[0]:
                    if block.evidence <= KIND or block.evidence >= 4:
                        found.append([float(block.evidence > 0), *text_features(block)])
            # equal rows are counted once per batch; values are rounded so that many are equal
            table = pd.DataFrame(np.round(found, 2)) if found else pd.DataFrame(np.empty((0, 9)))
            out = table.groupby(list(table.columns)).size().reset_index(name="n")
            out.columns = [*[f"c{i}" for i in range(9)], "n"]
            yield out.astype({"n": "int64"})

    names = [f"c{i}" for i in range(9)]
    grouped = (chosen.mapInPandas(moments, ", ".join(f"{c} double" for c in names) + ", n long")
               .groupBy(*names).agg(F.sum("n").alias("n")))
    seen = grouped.toPandas().sort_values(names)  # blocks of the sampled pages only
    y, x, n = seen["c0"].to_numpy(), seen[names[1:]].to_numpy(), seen["n"].to_numpy(float)
    if not len(seen) or y.min() == y.max():
        return []
    n = n * np.where(y > 0, 0.5 / n[y > 0].sum(), 0.5 / n[y <= 0].sum()) * len(seen)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + np.eye(len(w)), x.T @ (n * (p - y)) + w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every page.  A null or empty page has an empty text; repeated
    rows give repeated results."""
    weights = fit_text_model(pages, id_col, html)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                texts = [main_text(page, weights) for page in part.column(2).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()),
                                       pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


ship(__name__)
