"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text falls into a bin and every bin adds a number to the score, as does every cell of a
few feature pairs.  The numbers are learned by boosting shallow trees on one feature, then on one pair, at
a time, in turn; a tree of a feature is a step function over its bins, so the sum of all its trees is a
lookup table.  Scoring is a binary search and an addition for each feature, over whole blocks of texts.

The model is fitted on the driver from at most ``MAX_TRAIN`` labelled rows (those with the smallest hash of
their id).  Features come from all of a text.

Defined cases: null counts as empty, and empty texts get a score like any other; labels without a document,
or with a null id or label, teach nothing; without labels the score is 0.5 and with labels of one class
near that class; ids may repeat, every row is scored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnp
from .common import col, map_texts, require
from .repetition import covered_words, worded_lines

MAX_TRAIN = 50_000
#: The held-out rows: CRC-32 of the id as text, modulo 4, is 2.
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7

BINS, PAIR_BINS, PAIRS = 64, 16, 4
ROUNDS, PAIR_ROUNDS, RATE, SHRINK, LEAST = 80, 20, 0.15, 1.0, 5

FEATURES = ("log_words", "word_length", "longest_word", "symbols", "bangs", "pipes", "upper", "digits", "not_ascii",
            "distinct", "same_as_previous", "repeated", "repeated_lines", "line_words", "stops", "capital_starts", "short_words")


def _byte_class(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in characters]] = True
    return out


_CLASSES = {"symbols": _byte_class("#*$%&<>"), "bangs": _byte_class("!"), "pipes": _byte_class("|"),
            "upper": _byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digits": _byte_class("0123456789"),
            "stops": _byte_class(".,;:?")}


def features(block: textnp.Block) -> np.ndarray:
    """One row per text, one column per name in ``FEATURES``; shares are of bytes, words or lines."""
    owner, n = block.owner, np.diff(block.bounds)
    words, size = np.maximum(n, 1), np.maximum(np.diff(block.offsets), 1)
    lengths = block.ends - block.starts
    out = dict.fromkeys(FEATURES, np.zeros(block.n))
    out["log_words"] = np.log1p(n)
    out["word_length"] = np.bincount(owner, lengths, block.n) / words
    longest = np.zeros(block.n)
    np.maximum.at(longest, owner, lengths)
    out["longest_word"] = longest
    for name, kind in _CLASSES.items():
        out[name] = block.per_text(kind[block.data]) / size
    out["not_ascii"] = block.per_text(block.data >= 0x80) / size
    keys = textnp.mix(block.hashes + owner.astype(np.uint64))
    out["distinct"] = 1 - np.bincount(owner, textnp.repeats(keys)[1], block.n) / words
    same = np.concatenate(([False], keys[1:] == keys[:-1])) if len(keys) else np.zeros(0, bool)
    out["same_as_previous"] = np.bincount(owner, same, block.n) / words
    out["repeated"] = np.bincount(owner, covered_words(block, owner, 5), block.n) / words
    text, _, _, again = worded_lines(block)
    lines = np.maximum(np.bincount(text, minlength=block.n), 1)
    out["repeated_lines"] = np.bincount(text, again, block.n) / lines
    out["line_words"] = np.log1p(n / lines)
    out["capital_starts"] = np.bincount(owner, _CLASSES["upper"][block.data[block.starts]], block.n) / words
    out["short_words"] = np.bincount(owner, lengths <= 3, block.n) / words
    return np.stack([out[name] for name in FEATURES], axis=1).astype(np.float64)


@dataclass
class Model:
    """Lookup tables: by feature, and by pair of features (their bins in groups)."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        total = np.full(len(x), self.intercept)
        for b, table in zip(bins, self.tables, strict=True):
            total += table[b]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[_group(bins[i]), _group(bins[j])]
        return _sigmoid(total)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _group(bins: np.ndarray) -> np.ndarray:
    return bins * PAIR_BINS // BINS


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SHRINK)


def _cut(g: np.ndarray, h: np.ndarray, n: np.ndarray, lo: int, hi: int) -> tuple[float, int]:
    """(gain, place) of the best cut of bins lo..hi-1; place lo if there is none."""
    left_g, left_h, left_n = (np.cumsum(x[lo:hi])[:-1] for x in (g, h, n))
    total = [x[lo:hi].sum() for x in (g, h, n)]
    gain = _gain(left_g, left_h) + _gain(total[0] - left_g, total[1] - left_h) - _gain(total[0], total[1])
    gain[(left_n < LEAST) | (total[2] - left_n < LEAST)] = -1
    if not len(gain) or gain.max() <= 0:
        return 0.0, lo
    return float(gain.max()), lo + 1 + int(gain.argmax())


def _step(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int = 3) -> np.ndarray:
    """A tree over one feature: the value of each bin, constant on at most ``leaves`` ranges."""
    ranges = [(0, len(g))]
    while len(ranges) < leaves:
        (gain, at), k = max((_cut(g, h, n, *r), k) for k, r in enumerate(ranges))
        if gain <= 0:
            break
        lo, hi = ranges.pop(k)
        ranges += [(lo, at), (at, hi)]
    out = np.zeros(len(g))
    for lo, hi in ranges:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + SHRINK)
    return out


def _step2(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, value of each cell) of the best tree over a pair: a cut of one feature, then of the other on
    either side."""
    best = (0.0, np.zeros_like(g))
    for turn in (False, True):
        tables = [x.T if turn else x for x in (g, h, n)]
        for at in range(1, len(tables[0])):
            gain, value = 0.0, np.zeros_like(tables[0])
            for rows in (slice(0, at), slice(at, None)):
                gs, hs, ns = (x[rows].sum(axis=0) for x in tables)
                value[rows] = _step(gs, hs, ns, 2)
                found, cut = _cut(gs, hs, ns, 0, len(gs))
                gain += found + (_gain(gs.sum(), hs.sum()) if ns.sum() >= LEAST else 0)
            gain -= _gain(g.sum(), h.sum())
            if gain > best[0]:
                best = (gain, value.T if turn else value)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting on features, then on the pairs with the largest first gain."""
    model = Model()
    if not len(y):
        return model
    base = (y.sum() + 0.5) / (len(y) + 1)
    model.intercept = float(np.log(base / (1 - base)))
    model.edges = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS)) for c in x.T]
    bins = model.bins(x)
    model.tables = [np.zeros(BINS + 1) for _ in bins]
    logit = np.full(len(y), model.intercept)
    counts = [np.bincount(b, minlength=BINS + 1) for b in bins]
    for _ in range(ROUNDS):
        for b, table, n in zip(bins, model.tables, counts, strict=True):
            p = _sigmoid(logit)
            step = RATE * _step(np.bincount(b, y - p, BINS + 1), np.bincount(b, p * (1 - p), BINS + 1), n)
            table += step
            logit += step[b]

    groups = [_group(b) for b in bins]
    side = PAIR_BINS + 1

    def cells(i: int, j: int, weight: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(groups[i] * side + groups[j], weight, side * side).reshape(side, side)

    p = _sigmoid(logit)
    gains = sorted(((_step2(cells(i, j, y - p), cells(i, j, p * (1 - p)), cells(i, j))[0], i, j)
                    for i in range(len(bins)) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in gains[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((side, side)) for _ in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            p = _sigmoid(logit)
            step = RATE * _step2(cells(i, j, y - p), cells(i, j, p * (1 - p)), cells(i, j))[1]
            table += step
            logit += step[groups[i], groups[j]]
    return model


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
          max_train: int = MAX_TRAIN) -> Model:
    """A model from the labelled rows that are not held out, at most ``max_train`` of them."""
    require(docs, [doc_id, text])
    require(labels, [doc_id, label])
    known = labels.select(col(doc_id).alias("__id"), col(label).cast("double").alias("__y")).dropna()
    known = known.filter(~held_out("__id")).orderBy(F.xxhash64("__id"), "__id", "__y").limit(max_train)
    fields = [T.StructField(f"f{k}", T.DoubleType()) for k in range(len(FEATURES))]
    found = map_texts(docs.withColumnRenamed(doc_id, "__id"), ["__id"], text, textnp.Words.SPACED, fields,
                      lambda block: list(features(block).T))
    rows = found.join(known, "__id").select("__y", "__id", *[f.name for f in fields]).orderBy("__id", "__y", *[f.name for f in fields]).limit(max_train)
    table = rows.drop("__id").toPandas().to_numpy(dtype=np.float64)
    return fit(table[:, 1:], table[:, 0])


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns of every row, ``__score`` and ``__predicted``."""
    fields = [T.StructField("__score", T.DoubleType()), T.StructField("__predicted", T.IntegerType())]

    def run(block: textnp.Block) -> list[np.ndarray]:
        s = model.score(features(block))
        return [s, (s >= THRESHOLD).astype(np.int32)]

    return map_texts(docs, keep, text, textnp.Words.SPACED, fields, run)


def quality_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    scored = score(docs, train(docs, labels), ["doc_id"])
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), F.col("__score").alias("score"), F.col("__predicted").alias("predicted"))
