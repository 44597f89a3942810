"""Main text of web pages by a minimum cut between content and boilerplate."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import least_hashed, rows_of

_NAME_AT = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*|=[^\s/>=]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
_GAP = re.compile(r"[\s/]*")
_WORD = re.compile(r"[a-z]+")

# What HTML elements are.
RAW = frozenset("script style textarea title".split())
SILENT = RAW | frozenset("noscript template svg math iframe object canvas audio video select datalist".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img acronym".split())
#: What an opening element closes if it is open on top.
CLOSES = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
#: Elements that say themselves what they hold; they are never learned.
GIVEN = {"article": 5.0, "main": 3.0}
#: What the classifier believes before it sees a page, as log-odds of content: for elements, for words in class, id and role, and for a block's shape.
ELEMENT_PRIOR = {"nav": -9.0, "footer": -9.0, "aside": -9.0, "form": -9.0, "menu": -9.0, "dialog": -9.0, "button": -9.0, "fieldset": -9.0, "header": -4.0}
WORD_PRIOR = {
    **dict.fromkeys("article content post entry story main body text".split(), 2.0),
    **dict.fromkeys("ad ads advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion comment comments reply replies disqus sidebar nav navbar navigation menu footer cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login share sharing social related recommended breadcrumb breadcrumbs pagination pager masthead topbar toolbar widget search form copyright legal disclaimer complementary contentinfo dialog".split(), -9.0),
    "header": -4.0, "hidden": -9.0,
}
SHAPE_PRIOR = np.array([-0.3, 1.5, -5.0, 0.5])  # of 1, length in hundreds (4 at most), share of linked text, heading
#: Smoothness in units of ``UNIT``: between neighbours on the page, and more if they share a container.
UNIT, ADJACENT, SIBLING = 0.2, 2, 5
#: Bounds of the training sample: pages, blocks of each, spread over the page, and features of each.  Features must be on ``LEAST_PAGES`` of them.
SAMPLE_PAGES, SAMPLE_BLOCKS, SAMPLE_FEATURES, LEAST_PAGES, MOST_FEATURES = 500, 40, 200, 3, 256


@dataclass(frozen=True)
class Around:
    """An open element: its name, its container's number, its own features, and the element around it."""

    name: str = ""
    container: int = 0
    own: tuple[str, ...] = ()
    given: float = 0.0
    outer: Around | None = None

    def outwards(self) -> Iterator[Around]:
        """This element and all around it."""
        at: Around | None = self
        while at is not None:
            yield at
            at = at.outer

    @property
    def features(self) -> Iterator[str]:
        """The features of this element and of all around it, innermost first."""
        return (f for a in self.outwards() for f in a.own)


@dataclass
class Block:
    text: str
    around: Around
    linked: int
    heading: bool


def _attributes(page: str, at: int) -> tuple[list[str], bool, int]:
    """Words of class, id and role, whether the tag closes itself, and where it ends; one pass, whatever the markup.

    A quote within an unquoted value is part of it, as for browsers; a quote that is never closed is, too.
    """
    words: list[str] = []
    while True:
        gap = _GAP.match(page, at)
        at = gap.end()
        if at >= len(page):
            return words, False, at
        if page[at] == ">":
            return words, page[at - 1] == "/", at + 1
        found = _ATTRIBUTE.match(page, at)
        key, value = found[1].lower(), (found[2] or "").strip("\"'").lower()
        at = found.end()
        if key in ("class", "id", "role"):
            words += _WORD.findall(value)
        elif key == "hidden" or key == "aria-hidden" and "true" in value or key == "style" and "none" in value and re.search(r"display\s*:\s*none", value):
            words.append("hidden")


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order, each with what is around it.  Linear in the page, broken markup included.

    A silent element without an end tag is empty, an unclosed tag at the end of the page is dropped; all else is read.
    """
    blocks: list[Block] = []
    stack = [Around()]
    opened: Counter[str] = Counter()
    parts: list[str] = []
    without_end: set[str] = set()
    lower = page.lower() if page.isascii() else re.sub("[A-Z]+", lambda m: m[0].lower(), page)
    linked, links, serial, at = 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            blocks.append(Block(text, stack[-1], min(linked, len(text)), stack[-1].name in ("h1", "h2", "h3", "h4", "h5", "h6")))
        parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if links > 0:
            linked += len(text)

    def leave() -> None:
        opened[stack.pop().name] -= 1

    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            say(page[at:])
            break
        if start > at:
            say(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 2)
            at = end + 3 if end >= 0 else len(page)
            continue
        closing = page.startswith("</", start)
        tag = _NAME_AT.match(page, start + 1 + closing)
        if not tag:
            if page[start + 1 : start + 2] in ("!", "?", "/"):
                end = page.find(">", start)
                at = end + 1 if end >= 0 else len(page)
            else:
                say("<")
                at = start + 1
            continue
        name = tag[0].lower()
        words, own_end, at = _attributes(page, tag.end())
        if name == "a":
            links = max(0, links + (-1 if closing else 1))
        if closing:
            if name not in INLINE:
                flush()
                links = 0
            if opened[name] > 0:
                flush()
                while stack[-1].name != name:
                    leave()
                leave()
            continue
        if name in VOID:
            if name not in INLINE:
                flush()
            continue
        if name in SILENT:
            flush()
            end = -1 if own_end or name in without_end else lower.find(f"</{name}", at)
            if end < 0 and not own_end:
                without_end.add(name)
            if end >= 0 and (name in RAW or lower.find(f"<{name}", at, end) < 0):
                closed = page.find(">", end)
                at = closed + 1 if closed >= 0 else len(page)
            elif name in ("script", "style") and not own_end:
                after = page.find("<", at)
                at = after if after >= 0 else len(page)
            continue
        features = ([f"<{name}>"] if name not in GIVEN and name not in INLINE and name not in ("html", "body", "div", "p") else []) + [w for w in dict.fromkeys(words)]
        if name in INLINE:
            if opened[name] <= 0 and sum(WORD_PRIOR.get(w, 0.0) for w in words) >= 0:
                continue  # part of the text around it
            flush()
        else:
            flush()
            links = 0
            if stack[-1].name == "p":
                leave()
            while stack[-1].name in CLOSES.get(name, ()):
                leave()
        serial += 1
        outer = stack[-1]
        own = outer.container if name in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6") else serial
        stack.append(Around(name, own, tuple(features), outer.given + GIVEN.get(name, 0.0), outer))
        opened[name] += 1
    flush()
    return blocks


def shape_of(block: Block) -> np.ndarray:
    length = len(block.text)
    return np.array([1.0, min(length, 400) / 100.0, block.linked / length, float(block.heading)])


@dataclass
class Classifier:
    """Additive log-odds that a block is content.  Features that no sampled page has keep what is believed before."""

    weights: dict[str, float] = field(default_factory=lambda: {**{f"<{k}>": v for k, v in ELEMENT_PRIOR.items()}, **WORD_PRIOR})
    shape: np.ndarray = field(default_factory=SHAPE_PRIOR.copy)

    def around(self, block: Block, known: dict[int, float]) -> float:
        """The summed weights of all elements around a block.  ``known`` has the sums of elements met before, so a page takes one step for each."""
        chain = []
        for a in block.around.outwards():
            if id(a) in known:
                break
            chain.append(a)
        total = known[id(chain[-1].outer if chain else block.around)] if not chain or chain[-1].outer is not None else 0.0
        for a in reversed(chain):
            total += sum(self.weights.get(f, 0.0) for f in a.own)
            known[id(a)] = total
        return total

    def log_odds(self, block: Block, known: dict[int, float]) -> float:
        context = self.around(block, known) + block.around.given
        return max(-40.0, min(context, 12.0)) + float(self.shape @ shape_of(block))

    def fit(self, blocks: list[list[tuple[tuple[str, ...], np.ndarray, bool]]], pull: float = 0.002, steps: int = 400, rate: float = 1.0) -> Classifier:
        """Gradient descent on the mean logistic loss of the pages' blocks ``(features, shape, is content)``, pulled towards the prior."""
        pages = Counter(f for page in blocks for f in {f for fs, _, _ in page for f in fs})
        names = [f for f, n in sorted(pages.items(), key=lambda x: (-x[1], x[0])) if n >= LEAST_PAGES][:MOST_FEATURES]
        at = {f: k for k, f in enumerate(names)}
        rows = [row for page in blocks for row in page]
        labels = np.array([y for _, _, y in rows], float)
        if len(set(labels.tolist())) < 2:
            return self
        x = np.zeros((len(rows), len(names) + 4))
        x[:, len(names) :] = [s for _, s, _ in rows]
        fixed = np.zeros(len(rows))
        for i, (features, _, _) in enumerate(rows):
            for f in features:
                if f in at:
                    x[i, at[f]] += 1
                else:
                    fixed[i] += self.weights.get(f, 0.0)
        prior = np.concatenate([[self.weights.get(f, 0.0) for f in names], self.shape])
        w = prior.copy()
        step = rate / max(1.0, float((x**2).sum(axis=1).mean()) / 4)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w + fixed, -30, 30)))
            w -= step * (x.T @ (p - labels) / len(rows) + pull * (w - prior))
        return Classifier({**self.weights, **dict(zip(names, w[: len(names)].tolist(), strict=True))}, w[len(names) :])


def labelled_blocks(page: str) -> list[tuple[tuple[str, ...], np.ndarray, bool]]:
    """At most ``SAMPLE_BLOCKS`` blocks of a page that marks its article: what is in it, but not in an element known as boilerplate, is content.

    Of a deeply nested block the classifier learns from the ``SAMPLE_FEATURES`` innermost features; it is judged by all of them.
    """
    blocks = blocks_of(page)
    if not any(b.around.given > 0 for b in blocks):
        return []
    prior = Classifier().weights
    pick = np.unique(np.linspace(0, len(blocks) - 1, SAMPLE_BLOCKS).astype(int))
    return [(tuple(islice(b.around.features, SAMPLE_FEATURES)), shape_of(b), b.around.given > 0 and all(prior.get(f, 0.0) >= 0 for f in b.around.features)) for b in (blocks[i] for i in pick)]


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) of the least total cost: a block against its cost, or an edge whose ends differ.

    Positive costs are capacities from the source, negative ones to the sink.  Maximum flow in phases: levels from all blocks with
    capacity left, then paths from level to level until none is left.  What the source still reaches is content.  Flow stays near
    where it starts, as each block on its way takes at least a unit of it, so phases are few and each is linear.
    """
    n, excess, none = len(costs), list(costs), 1e-9
    out: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[float] = []
    for a, b, w in edges:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to += (b, a)
        room += (w, w)
    while True:
        front = [i for i in range(n) if excess[i] > none]
        sources, level, depth, met = list(front), [-1] * n, 0, False
        for i in front:
            level[i] = 0
        while front and not met:
            depth += 1
            reached = []
            for a in front:
                for e in out[a]:
                    b = to[e]
                    if level[b] < 0 and room[e] > none:
                        level[b] = depth
                        reached.append(b)
                        met = met or excess[b] < -none
            front = reached
        if not met:
            return [x >= 0 for x in level]
        nexts = [0] * n
        for source in sources:
            path: list[int] = []
            a = source
            while excess[source] > none:
                if excess[a] < -none:
                    amount = min(excess[source], -excess[a], *(room[e] for e in path))
                    excess[source] -= amount
                    excess[a] += amount
                    for e in path:
                        room[e] -= amount
                        room[e ^ 1] += amount
                    path, a = [], source
                    continue
                edges_of = out[a]
                while nexts[a] < len(edges_of):
                    e = edges_of[nexts[a]]
                    if room[e] > none and level[to[e]] == level[a] + 1:
                        break
                    nexts[a] += 1
                if nexts[a] < len(edges_of):
                    path.append(e)
                    a = to[e]
                elif path:
                    a = to[path.pop() ^ 1]
                    nexts[a] += 1
                else:
                    break


def content_blocks(page: str | None, classifier: Classifier) -> list[tuple[Block, bool]]:
    """The page's blocks, and whether the minimum cut leaves them on the side of content."""
    blocks = blocks_of(page or "")
    edges, last = [], {}
    for i, block in enumerate(blocks):
        if i:
            edges.append((i - 1, i, ADJACENT))
        if block.around.container in last:
            edges.append((last[block.around.container], i, SIBLING))
        last[block.around.container] = i
    known: dict[int, float] = {}
    units = [round(classifier.log_odds(b, known) / UNIT) or -1 for b in blocks]
    return list(zip(blocks, minimum_cut(units, edges), strict=True))


def main_text(page: str | None, classifier: Classifier | None = None) -> str:
    """The page's content blocks joined by one space; empty if there are none."""
    return " ".join(b.text for b, keep in content_blocks(page, classifier or Classifier()) if keep)


def train(pages: DataFrame, learn: F.Column | None = None, id_col: str = "page_id", html_col: str = "html") -> Classifier:
    """Fits the classifier on at most ``SAMPLE_PAGES`` pages (least hashes, among those that ``learn`` admits), ``SAMPLE_BLOCKS`` blocks each."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html"), (F.lit(True) if learn is None else learn).alias("learn"))
    usable = rows.where("learn and html is not null and page_id is not null").select("page_id", "html")
    layout = "page_id long, tie long, features array<array<string>>, shapes array<double>, content array<boolean>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches, 64):
            found = [labelled_blocks(r["html"]) for r in part]
            columns = [[list(f) for f, _, _ in x] for x in found], [np.concatenate([s for _, s, _ in x]).tolist() if x else [] for x in found], [[y for _, _, y in x] for x in found]
            types = pa.list_(pa.list_(pa.string())), pa.list_(pa.float64()), pa.list_(pa.bool_())
            ids = [pa.array([r[c] for r in part], pa.int64()) for c in ("page_id", "tie")]
            yield pa.RecordBatch.from_arrays(ids + [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["page_id", "tie", "features", "shapes", "content"])

    # However many rows share an id, so many pages come to the driver at most.
    sample = least_hashed(usable, SAMPLE_PAGES).select("page_id", F.xxhash64("html").alias("tie"), "html").mapInArrow(run, layout)
    sample = sample.dropDuplicates(["page_id", "tie"]).orderBy(F.xxhash64("page_id"), "page_id", "tie").limit(SAMPLE_PAGES).collect()
    found = [[(tuple(f), np.array(r["shapes"][4 * k : 4 * k + 4]), y) for k, (f, y) in enumerate(zip(r["features"], r["content"], strict=True))] for r in sample]
    return Classifier().fit([x for x in found if x])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", classifier: Classifier | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page: the whole article without what surrounds it.

    Blocks are nodes of a graph.  A classifier's log-odds are the terminal capacities; blocks that are neighbours on the page, and
    next siblings in one container, are joined by smoothness edges; the maximum flow's minimum cut separates content from boilerplate.
    Without a ``classifier`` one is trained on a bounded sample of these pages.

    A null or empty page gives an empty text with 0 characters; broken markup is tolerated.  One row per input row, each on its
    own, so repeated rows are equal.  Other columns are not read.  An empty table gives an empty result.
    """
    fitted = classifier or train(pages, None, id_col, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches, 64):
            texts = [main_text(r["html"], fitted) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["page_id"] for r in rows], pa.int64()), pa.array([r["url"] for r in rows], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
