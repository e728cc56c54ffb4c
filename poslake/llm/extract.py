"""Main text of web pages by minimum cuts over their text blocks.

A logistic classifier gives each block the cost of either label: the log odds that it is content.  These are the capacities
to the two terminals.  Smoothness edges join blocks that follow each other, weaker the farther apart their
containers stand in the DOM, and blocks that follow each other within one container though others stand between.  The
minimum cut of that graph labels all blocks of a page at once.

Blocks whose terminal outweighs all their edges are labelled first, which shrinks the graph without changing
the cut; what is left falls into small components, each solved by blocking flows.  Capacities are whole
numbers, so the cut is exact.

The weights of a block's own features (words, links, sentence ends, tag) are fitted on a bounded sample: of the ``TRAIN_PAGES`` pages with
the smallest hash, at most ``TRAIN_BLOCKS`` blocks each, labelled by the elements they stand in (``article`` and
``main`` against ``nav``, ``footer`` and the like) and drawn to stated weights, which hold alone where a sample has one label only.  What
the elements say about a block is added with fixed weights.

Defined cases: null, empty and textless pages give an empty text; unclosed tags and cut references are read as browsers
do; repeated rows and null ids are rows like any other; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import dom
from .common import col, require, text_or_empty

TRAIN_PAGES, TRAIN_BLOCKS = 500, 200
#: Stated weights: none, log words, share of linked characters, sentence end, copyright sign, paragraph, heading, list item.
PRIOR = np.array([-1.2, 0.7, -3.5, 0.8, -3.0, 0.8, 0.5, -0.5])
#: How strongly weights are drawn to the stated ones, against the mean loss of a block; a small sample counts for less.
RIDGE, RIDGE_BLOCKS = 0.2, 100
#: Words beyond which a block says no more by its length.
MANY_WORDS = 50
#: Log odds that a block's place adds.
PLACE = {dom.STICKY: -8.0, dom.WEAK: -4.0, dom.NONE: 0.0, dom.CONTENT: 3.0}
#: Weight of the edge between neighbours in one container, and of the one across others in between.
ADJACENT, ACROSS = 1.5, 0.75
#: Steps between containers beyond which neighbours share no edge.
FARTHEST = 8
#: Capacities are whole numbers of this many a unit.
SCALE = 1000

_ENDS = tuple(".!?…。！？")


def features(block: dom.Block) -> tuple[float, ...]:
    return (1.0, float(np.log1p(min(block.words, MANY_WORDS))), block.linked, float(block.text.rstrip("\"'”’»)").endswith(_ENDS)), float("©" in block.text[:200]),
            float(block.tag == "p"), float(block.tag in ("h1", "h2", "h3")), float(block.tag == "li"))


def steps_between(page: dom.Page, a: int, b: int, most: int = FARTHEST) -> int:
    """Steps from element ``a`` to ``b`` along parents; more than ``most`` if they are farther apart."""
    steps = 0
    while a != b and steps <= most:
        if page.depth[a] < page.depth[b]:
            a, b = b, a
        a, steps = page.parent[a], steps + 1
    return steps


def edges(page: dom.Page) -> list[tuple[int, int, int]]:
    """Smoothness edges (block, later block, capacity)."""
    found, last = [], {}
    for i, block in enumerate(page.blocks):
        if i:
            steps = steps_between(page, page.blocks[i - 1].container, block.container)
            if steps <= FARTHEST:
                found.append((i - 1, i, round(SCALE * ADJACENT / (1 + steps))))
        before = last.get(block.container)
        if before is not None and before < i - 1:
            found.append((before, i, round(SCALE * ACROSS)))
        last[block.container] = i
    return found


def min_cut(odds: list[int], links: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes lie on the source side of a minimum cut: ``odds`` are capacities from the source (above zero)
    or to the sink (below), ``links`` run both ways."""
    n = len(odds)
    beside: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, w in links:
        if a != b and w > 0:
            beside[a][b] = beside[a].get(b, 0) + w
            beside[b][a] = beside[b].get(a, 0) + w
    odds, around = list(odds), [sum(x.values()) for x in beside]
    side: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:  # nodes whose terminal outweighs their edges
        i = todo.pop()
        if side[i] is not None or abs(odds[i]) < around[i]:
            continue
        side[i] = odds[i] > 0
        for j, w in beside[i].items():
            if side[j] is None:
                del beside[j][i]
                around[j] -= w
                odds[j] += w if side[i] else -w
                todo.append(j)
        beside[i] = {}
    left = [i for i in range(n) if side[i] is None]
    if left:
        for i, content in zip(left, _blocking_flows(left, odds, beside), strict=True):
            side[i] = content
    return [bool(x) for x in side]


def _blocking_flows(nodes: list[int], odds: list[int], residual: list[dict[int, int]]) -> list[bool]:
    """Max-flow over what is left, by levels; the nodes that the source still reaches are its side."""
    supply, demand = {i: max(odds[i], 0) for i in nodes}, {i: max(-odds[i], 0) for i in nodes}
    while True:
        level = {i: 0 for i in nodes if supply[i]}
        queue, met = list(level), False
        for i in queue:
            met = met or demand[i] > 0
            for j, room in residual[i].items():
                if room and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not met:
            return [i in level for i in nodes]
        ways = {i: iter(list(residual[i])) for i in level}
        for start in [i for i in nodes if supply[i]]:
            path = [start]
            while path and supply[start]:
                at = path[-1]
                if demand[at]:
                    flow = min(supply[start], demand[at], *(residual[a][b] for a, b in zip(path, path[1:], strict=False)))
                    supply[start] -= flow
                    demand[at] -= flow
                    for a, b in zip(path, path[1:], strict=False):
                        residual[a][b] -= flow
                        residual[b][a] += flow
                    full = next((k for k in range(len(path) - 1) if not residual[path[k]][path[k + 1]]), None)
                    if full is not None:
                        del path[full + 1:]
                    continue
                step = next((j for j in ways[at] if residual[at][j] and level.get(j) == level[at] + 1), None)
                if step is None:
                    path.pop()
                else:
                    path.append(step)


def content_blocks(page: dom.Page, weights: np.ndarray) -> list[bool]:
    """The label of each block of a page."""
    if not page.blocks:
        return []
    score = np.array([features(b) for b in page.blocks]) @ weights + [PLACE[b.place] for b in page.blocks]
    return min_cut(np.rint(SCALE * score).astype(np.int64).tolist(), edges(page))


def main_text(html: str, weights: np.ndarray = PRIOR) -> str:
    page = dom.parse(html)
    return "\n".join(b.text for b, content in zip(page.blocks, content_blocks(page, weights), strict=True) if content)


def fit_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton steps, drawn to the stated ones."""
    w = PRIOR.copy()
    if not len(y) or y.min() == y.max():
        return w
    ridge = RIDGE + RIDGE_BLOCKS / len(y)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) / len(y) + ridge * (w - PRIOR)
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(pages: DataFrame, html: str = "html") -> np.ndarray:
    """Weights from the sample: equal pages count once, and the driver gets ``TRAIN_PAGES * TRAIN_BLOCKS`` rows at most."""
    keyed = pages.select(text_or_empty(html).alias("html"), F.xxhash64(text_or_empty(html)).alias("key"))
    smallest = keyed.select("key").distinct().orderBy("key").limit(TRAIN_PAGES).agg(F.max("key")).first()[0]
    if smallest is None:
        return PRIOR.copy()
    sample = keyed.filter(F.col("key") <= smallest).groupBy("key").agg(F.any_value("html").alias("html"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                told = [b for b in dom.parse(text.as_py()).blocks if b.place != dom.NONE]
                told = told[::-(-len(told) // TRAIN_BLOCKS) or 1]  # spread over the page
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(told), pa.int64()), pa.array([list(features(b)) for b in told], pa.list_(pa.float64())),
                                                  pa.array([float(b.place == dom.CONTENT) for b in told], pa.float64())], ["key", "x", "y"])

    rows = sorted((r["key"], *r["x"], r["y"]) for r in sample.select("key", "html").mapInArrow(measure, "key long, x array<double>, y double").collect())
    data = np.array(rows).reshape(-1, 2 + len(PRIOR))
    return fit_weights(data[:, 1:-1], data[:, -1])


def extract(pages: DataFrame, keep: list[str], weights: np.ndarray, html: str = "html") -> DataFrame:
    """``keep`` columns of every page and its main ``__text``."""
    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField("__text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), weights) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(texts, pa.string())], schema.names)

    return pages.select(*[col(c) for c in keep], text_or_empty(html).alias("__html")).mapInArrow(run, schema)


def extract_table(pages: DataFrame) -> DataFrame:
    """page_id, url, ``text`` and its ``n_chars`` for every page."""
    require(pages, ("page_id", "url", "html"))
    found = extract(pages, ["page_id", "url"], train(pages))
    return found.select("page_id", "url", F.col("__text").alias("text"), F.length("__text").cast("long").alias("n_chars"))
