"""HTML extraction by minimum-cut labelling.

A page is cut into blocks, the runs of text between block-level tags. A logistic
classifier gives each block the probability that it is content; its costs, the
negative log-likelihoods of both labels, are the capacities to source and sink.
Blocks that follow each other, and blocks whose elements are near in the tree, are
joined by edges that cost something when their ends get different labels. The
minimum cut, by maximum flow, is the labelling of least total cost; of equal ones
the one with the fewest content blocks.

The classifier is trained here, in numpy, on a bounded sample: ``sample_blocks`` blocks
of ``sample_pages`` different pages at most; executors read those pages, only numbers
come to the driver. A block's label in training comes from the page's own semantic
elements (article and main against nav, footer, aside, header and form); the
features don't look at those, so pages without such elements are judged alike.

Defined results:

* a null page stays null; an empty one, or one without text, gives an empty text; a
  null key gets its row as any other; a very long page is one page and is read whole;
* texts in script, style, template, noscript, svg and head (but its title is kept
  apart), and comments, are in no block; unclosed and stray tags are tolerated;
* without a page to learn from (none, or without both kinds of blocks) the weights
  of ``PRIOR`` are used;
* repeated rows each get their result, but count once in training; a tie between
  labellings of equal cost goes to the one with the fewest content blocks;
* other columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "text string, title string, blocks int, kept int"
ARROW = pa.struct([("text", pa.string()), ("title", pa.string()), ("blocks", pa.int32()), ("kept", pa.int32())])
SMOOTH = 0.6
NEAR = 0.4
#: How many blocks ahead all are looked at, and up to which distance in the tree an edge is made. Further ahead the next near block below each ancestor gets one.
AHEAD, DISTANCE = 4, 4
SCALE = 1000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|svg|textarea)\b[^<>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^<>]*>",
    re.S | re.I,
)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEAD = frozenset("title meta link base".split())
_GOOD = frozenset(["article", "main"])
_BAD = frozenset(["nav", "footer", "aside", "header", "form"])
_BAD_CLASS = re.compile(r"\b(?:ads?|advert\w*|sponsor\w*|sidebar|menu|cookie\w*|banner|promo\w*)\b", re.I)
_CLOSES = {"p": ("p",), "li": ("li", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "dd": ("dd", "dt", "p"), "dt": ("dd", "dt", "p"), "option": ("option",)}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\w+")
_STOP = re.compile(r"[.!?;:,](?=\s|$)")
FEATURES = 12
PRIOR = np.array([-1.2, 0.5, 0.25, 2.0, -3.5, 1.0, -1.5, 0.6, 0.5, -0.5, 0.0, 0.0])


class Block:
    """A run of text: how many of its characters are in links, the elements around it, its label if it has one."""

    __slots__ = ("label", "linked", "path", "tag", "text")

    def __init__(self, text: str, linked: int, path: tuple[int, ...], tag: str, label: int):
        self.text, self.linked, self.path, self.tag, self.label = text, linked, path, tag, label


def blocks_of(page: str) -> tuple[list[Block], str]:
    """(blocks in order, title). A block knows the path of its elements and, for training, what surrounds it."""
    found: list[Block] = []
    names: list[str] = []
    path: list[int] = []
    kinds: list[int] = [0]  # 1 in content elements, -1 in others, 0 else
    parts: list[str] = []
    number = linked = in_link = 0
    in_title = in_head = False
    title: list[str] = []

    def close() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                found.append(Block(text, min(linked, len(text)), tuple(path), names[-1] if names else "", kinds[-1]))
            parts.clear()
        linked = 0

    def pop(i: int) -> None:
        del names[i:], path[i:], kinds[i + 1 :]

    at = 0
    for m in _TOKEN.finditer(page):
        start = m.start()
        if start > at:
            chunk = page[at:start]
            if in_title:
                title.append(chunk)
            elif not in_head:
                parts.append(chunk)
                if in_link:
                    linked += len(chunk.strip())
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if m[2]:
            if name == "a":
                in_link = max(0, in_link - 1)
            elif name == "title":
                in_title = False
            elif name == "head":
                in_head = False
                close()
            elif name not in _INLINE and name not in _VOID:
                close()
                for i in range(len(names) - 1, -1, -1):
                    if names[i] == name:
                        pop(i)
                        break
            continue
        if in_head and name not in _HEAD:
            in_head = False  # left out, as often
        if name == "a":
            in_link += 1
        elif name == "title" and (in_head or not found):
            in_title = True
        elif name == "head":
            in_head = True
        elif name == "br":
            parts.append("\n")
        elif name not in _INLINE:
            if name == "body":
                in_title = False
            close()
            if name not in _VOID:
                if name in _ENDS_P and "p" in names and names[-1] == "p":
                    pop(len(names) - 1)
                for other in _CLOSES.get(name, ()):
                    if names and names[-1] == other:
                        pop(len(names) - 1)
                number += 1
                names.append(name)
                path.append(number)
                attributes = m[4]
                kinds.append(1 if name in _GOOD else -1 if name in _BAD or (attributes and _BAD_CLASS.search(attributes)) else kinds[-1])
    if at < len(page):
        (title if in_title else parts).append(page[at:])
    close()
    return found, _SPACE.sub(" ", entities.unescape("".join(title))).strip()


def features(blocks: list[Block]) -> np.ndarray:
    """(blocks, FEATURES)."""
    n = len(blocks)
    x = np.zeros((n, FEATURES))
    size = np.array([len(b.text) for b in blocks], float)
    words = np.array([len(_WORD.findall(b.text)) for b in blocks], float)
    stops = np.array([len(_STOP.findall(b.text)) for b in blocks], float)
    x[:, 0] = 1
    x[:, 1] = np.log1p(words)
    x[:, 2] = np.log1p(size)
    x[:, 3] = np.minimum(1, stops / np.maximum(words, 1) * 5)
    x[:, 4] = np.array([b.linked for b in blocks]) / np.maximum(size, 1)
    x[:, 5] = [b.tag in ("p", "blockquote", "pre", "td") for b in blocks]
    x[:, 6] = [b.tag in ("li", "ul", "ol", "option", "button", "label", "th") for b in blocks]
    x[:, 7] = [b.tag in ("h1", "h2", "h3", "h4", "h5", "h6") for b in blocks]
    around = np.zeros(n)
    around[1:] += x[:-1, 1]
    around[:-1] += x[1:, 1]
    x[:, 8] = around / 2
    x[:, 9] = ["©" in b.text or "·" in b.text or "|" in b.text for b in blocks]
    x[:, 10] = np.arange(n) / max(1, n - 1)
    x[:, 11] = [len(b.path) / 10 for b in blocks]
    return x


def examples(page: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, content or not) of the blocks in semantic elements."""
    blocks, _ = blocks_of(page)
    if not blocks:
        return np.zeros((0, FEATURES)), np.zeros(0, dtype=bool)
    label = np.array([b.label for b in blocks])
    return features(blocks)[label != 0], label[label != 0] > 0


def train(x: np.ndarray, y: np.ndarray, steps: int = 25, ridge: float = 1.0) -> np.ndarray:
    """Weights by Newton's method for logistic regression on examples."""
    y = y.astype(float)
    if not len(y) or y.min() == y.max():
        return PRIOR
    w = np.zeros(FEATURES)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(FEATURES), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def min_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stand on the source's side of a minimum cut, the one with the fewest there.

    source and sink: capacities from the source and to the sink; edges: (a, b, capacity both ways)."""
    n = len(source)
    excess = [s - t for s, t in zip(source, sink, strict=True)]
    near: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    left: list[int] = []
    for a, b, c in edges:
        near[a].append(len(to))
        near[b].append(len(to) + 1)
        to += (b, a)
        left += (c, c)
    while True:
        # levels from all sources at once
        level = [-1] * n
        queue = deque(i for i in range(n) if excess[i] > 0)
        for i in queue:
            level[i] = 0
        reach = False
        while queue:
            i = queue.popleft()
            for e in near[i]:
                j = to[e]
                if left[e] and level[j] < 0:
                    level[j] = level[i] + 1
                    reach |= excess[j] < 0
                    queue.append(j)
        if not reach:
            return [x >= 0 for x in level]
        following = [0] * n
        for s in range(n):
            while excess[s] > 0 and level[s] == 0:
                # one path from s along rising levels, to a node that can drain
                trail: list[int] = []
                i = s
                while excess[i] >= 0 or i == s:
                    while following[i] < len(near[i]):
                        e = near[i][following[i]]
                        if left[e] and level[to[e]] == level[i] + 1:
                            break
                        following[i] += 1
                    if following[i] < len(near[i]):
                        trail.append(near[i][following[i]])
                        i = to[trail[-1]]
                    elif trail:
                        i = to[trail.pop() ^ 1]
                        following[i] += 1
                    else:
                        break
                if not trail:
                    break
                flow = min(excess[s], -excess[i], *(left[e] for e in trail))
                for e in trail:
                    left[e] -= flow
                    left[e ^ 1] += flow
                excess[s] -= flow
                excess[i] += flow


def edges_of(blocks: list[Block], smooth: float, near: float) -> list[tuple[int, int, int]]:
    """Edges of neighbours, and of blocks near in the tree: the fewer steps apart, the dearer to separate.

    However many blocks stand between, each block is joined to the last one before it in each place of the
    tree (so many steps up, so many down) within DISTANCE; that is linear in the blocks."""
    out: dict[tuple[int, int], float] = {}
    last: dict[tuple[tuple[int, ...], int], int] = {}
    for i, one in enumerate(blocks):
        a = one.path
        for j in range(i + 1, min(len(blocks), i + 1 + AHEAD)):
            b = blocks[j].path
            same, most = 0, min(len(a), len(b))
            while same < most and a[same] == b[same]:
                same += 1
            steps = len(a) + len(b) - 2 * same
            weight = smooth if j == i + 1 else 0.0
            if steps <= DISTANCE:
                weight += near / (1 + steps)
            if weight:
                out[i, j] = weight
        for up in range(min(DISTANCE, len(a)) + 1):
            top = a[: len(a) - up]
            for down in range(DISTANCE + 1 - up):
                h = last.get((top, down))
                if h is not None and i - h >= AHEAD and (h, i) not in out:
                    b, same = blocks[h].path, len(top)
                    while same < min(len(a), len(b)) and a[same] == b[same]:
                        same += 1
                    out[h, i] = near / (1 + len(a) + len(b) - 2 * same)
        for up in range(min(DISTANCE, len(a)) + 1):
            last[a[: len(a) - up], up] = i
    return [(i, j, int(w * SCALE)) for (i, j), w in out.items()]


def labelled(blocks: list[Block], weights: np.ndarray, smooth: float = SMOOTH, near: float = NEAR) -> list[bool]:
    """Which blocks are content."""
    if not blocks:
        return []
    z = np.clip(features(blocks) @ weights, -20, 20)
    cost_content, cost_other = np.logaddexp(0, -z), np.logaddexp(0, z)
    return min_cut([int(c * SCALE) for c in cost_other], [int(c * SCALE) for c in cost_content], edges_of(blocks, smooth, near))


def extract(page: str, weights: np.ndarray, smooth: float = SMOOTH, near: float = NEAR) -> tuple[str, str, int, int]:
    """(text, title, blocks, blocks kept)."""
    blocks, title = blocks_of(page)
    kept = [b.text for b, on in zip(blocks, labelled(blocks, weights, smooth, near), strict=True) if on]
    return "\n".join(kept), title, len(blocks), len(kept)


def sample(pages: DataFrame, html: str, most_pages: int, most_blocks: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Examples from the pages of the least seeded hashes; of too many blocks again those of the least hashes."""
    some = pages.select(pages[html].alias("html"), F.xxhash64(pages[html], F.lit(seed)).alias("k")).filter("html is not null")
    kinds = some.agg(F.approx_count_distinct("k")).first()[0]
    some = some.filter(F.pmod(F.xxhash64("html"), F.lit(1 << 20)) < int(min(1.0, 4 * most_pages / max(1, kinds)) * (1 << 20)) + 1)
    keys = [r[0] for r in some.select("k").distinct().orderBy("k").limit(most_pages).collect()]
    if not keys:
        return np.zeros((0, FEATURES)), np.zeros(0, dtype=bool)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for page in b.column("html"):
                x, y = examples(page.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), pa.array(y)], ["x", "y"])

    found = some.filter(F.col("k") <= keys[-1]).dropDuplicates(["k"]).select("html").mapInArrow(read, "x array<double>, y boolean")
    got = found.orderBy(F.xxhash64("x", "y", F.lit(seed)), "y", "x").limit(most_blocks).toArrow()
    return np.array(got["x"].to_pylist(), float).reshape(-1, FEATURES), got["y"].to_numpy().astype(bool)


def fit(pages: DataFrame, *, html: str = "html", sample_pages: int = 200, sample_blocks: int = 20_000, seed: int = 5) -> np.ndarray:
    return train(*sample(pages, html, sample_pages, sample_blocks, seed))


def extractor(weights: np.ndarray, smooth: float = SMOOTH, near: float = NEAR):
    """An Arrow UDF from a page to a struct of SCHEMA."""

    @F.arrow_udf(SCHEMA)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            got = [extract(p.as_py(), weights, smooth, near) if p.is_valid else (None, None, 0, 0) for p in pages]
            yield pa.StructArray.from_arrays([pa.array([x[i] for x in got], f.type) for i, f in enumerate(ARROW)], fields=list(ARROW))

    return run


def extracted(pages: DataFrame, weights: np.ndarray, *, key: str = "page_id", html: str = "html", **options) -> DataFrame:
    """(key, text, title, blocks, kept) of every page."""
    return pages.select(pages[key].alias("k"), extractor(weights, **options)(pages[html]).alias("r")).select(F.col("k").alias(key), "r.*")
