"""Quality rules on repetition: characters inside duplicated n-grams and lines.

Rolling hashes of several n-gram lengths run over the words of a block of texts at once, in numpy.  A
text fails when the share of its word characters inside n-grams found twice or more exceeds the limit of
any length, or that inside lines equal to an earlier line exceeds the line limit.

Defined cases: null counts as empty; a text without words has no repetition and fails the base rule for
its few words; ids may be null or repeat, every row is judged by itself; an empty table gives no rows;
of other columns only those asked for are kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textnp
from .common import map_texts, require

#: Greatest share of word characters inside duplicated n-grams, by n, and inside duplicated lines: the
#: published values (Gopher).  Those of n-grams lie below the base rule's share and fall with n.
NGRAM_LIMITS = {5: 0.15, 7: 0.13, 10: 0.10}
LINE_LIMIT = 0.20
#: The base rule: least words, and percent of words in repeated windows of 5.
MIN_WORDS, BASE_WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def covered_words(block: textnp.Block, owner: np.ndarray, n: int) -> np.ndarray:
    """Flags of the words inside n-word windows that their text holds twice or more."""
    grams = textnp.ngrams(block.hashes, n)
    valid = np.flatnonzero(owner[:len(grams)] == owner[n - 1:]) if len(grams) else np.zeros(0, np.int64)
    twice, _ = textnp.repeats(textnp.mix(grams[valid] + owner[valid].astype(np.uint64)))
    at = valid[twice]
    step = np.bincount(at, minlength=len(owner) + n) - np.bincount(at + n, minlength=len(owner) + n)
    return np.cumsum(step)[:len(owner)] > 0


def worded_lines(block: textnp.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, equal to an earlier line of the text) of each line with a word."""
    feeds = np.flatnonzero(block.data == 0x0A)
    begins = block.offsets[:-1]
    ends = block.offsets[1:]
    starts = np.concatenate((begins, feeds + 1))
    stops = np.concatenate((feeds, ends))
    starts.sort()
    stops.sort()
    text = np.concatenate((np.arange(block.n), np.searchsorted(block.offsets, feeds, "right") - 1))
    text.sort()
    has_word = np.searchsorted(block.starts, stops) > np.searchsorted(block.starts, starts)
    text, starts, stops = text[has_word], starts[has_word], stops[has_word]
    keys = textnp.mix(block.span_hashes(starts, stops) + text.astype(np.uint64))
    return text, starts, stops, textnp.repeats(keys)[1]


def measure(block: textnp.Block) -> dict[str, np.ndarray]:
    """Counts of each text of a block; ``cover_n`` and ``cover_lines`` are shares of word characters."""
    owner = block.owner
    n_words = np.diff(block.bounds).astype(np.int64)
    code_points = np.concatenate(([0], np.cumsum((block.data & 0xC0) != 0x80, dtype=np.int64)))
    chars = code_points[block.ends] - code_points[block.starts]
    total = np.bincount(owner, chars, block.n).astype(np.int64)
    text, starts, stops, again = worded_lines(block)
    first, last = np.searchsorted(block.starts, starts[again]), np.searchsorted(block.starts, stops[again])
    by_word = np.concatenate(([0], np.cumsum(chars)))
    out = {"n_words": n_words, "word_chars": total, "n_symbols": block.per_text(_SYMBOL[block.data]),
           "n_dup_lines": np.bincount(text[again], minlength=block.n).astype(np.int64)}
    share = np.maximum(total, 1)
    out["cover_lines"] = np.bincount(text[again], by_word[last] - by_word[first], block.n) / share
    for n in sorted({BASE_WINDOW, *NGRAM_LIMITS}):
        inside = covered_words(block, owner, n)
        if n == BASE_WINDOW:
            out["n_repeat_words"] = np.bincount(owner, inside, block.n).astype(np.int64)
        if n in NGRAM_LIMITS:
            out[f"cover_{n}"] = np.bincount(owner, inside * chars, block.n) / share
    return out


def judge(found: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(base rule failed, kept)."""
    failed = (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > MAX_REPEAT_PERCENT * found["n_words"])
    kept = ~failed & (found["cover_lines"] <= LINE_LIMIT)
    for n, most in NGRAM_LIMITS.items():
        kept &= found[f"cover_{n}"] <= most
    return failed, kept


def repetition(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns of every row, its counts and shares, ``base_failed`` and ``kept``."""
    require(docs, [*keep, text])
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    shares = [f"cover_{n}" for n in NGRAM_LIMITS] + ["cover_lines"]
    fields = [T.StructField(c, T.LongType()) for c in counts] + [T.StructField(c, T.DoubleType()) for c in shares]
    fields += [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]

    def run(block: textnp.Block) -> list[np.ndarray]:
        found = measure(block)
        return [found[c] for c in counts + shares] + list(judge(found))

    return map_texts(docs, keep, text, textnp.Words.SPACED, fields, run)
