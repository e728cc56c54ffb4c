"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column.

One batch of texts is cut into blocks of about ``BLOCK`` bytes (a longer text is a block of its own),
so the working memory stays a small multiple of the block or of the longest single text.  A word is
known by a 64-bit hash: a polynomial over random byte values, taken from prefix sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from enum import Enum
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

_SPACED = np.ones(256, bool)
_SPACED[[0x20, *range(0x09, 0x0E)]] = False
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


class Words(Enum):
    """What a word is: bytes other than white space (space, tab to carriage return), with A-Z as they are or
    lower-cased; or digits, lower-cased letters and all that is not ASCII."""

    SPACED = "spaced"
    SPACED_LOWER = "spaced, lower case"
    ALNUM = "alphanumeric"


@cache
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20240607).integers(0, 1 << 64, 256, dtype=U64, endpoint=False)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK + 1)
        have = np.full(size, base, U64)
        have[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@dataclass
class Block:
    """Texts ``first`` to ``first + n - 1`` of a batch.

    ``data`` holds their bytes (A-Z lower-cased if the kind says so), text i at ``offsets[i]`` to
    ``offsets[i + 1]``; its words are ``bounds[i]`` to ``bounds[i + 1]`` of ``starts``, ``ends`` and
    ``hashes``."""

    first: int
    n: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray
    sums: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.n), np.diff(self.bounds))

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _span_hashes(self.sums, starts, ends)

    def sequence_hashes(self) -> np.ndarray:
        """A hash of each text's whole word sequence."""
        sums = np.zeros(len(self.hashes) + 1, U64)
        np.cumsum(self.hashes * _powers(_BASE, len(self.hashes)), out=sums[1:])
        return _span_hashes(sums, self.bounds[:-1], self.bounds[1:])

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many of the flagged bytes each text has."""
        return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[self.offsets])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets


def blocks(column: pa.Array, kind: Words) -> Iterator[Block]:
    """The words of a column's texts, block by block."""
    if not len(column):
        return
    data, offsets = text_bytes(column)
    lo = 0
    while lo < len(offsets) - 1:
        hi = int(np.searchsorted(offsets, offsets[lo] + BLOCK, "right")) - 1
        hi = min(max(hi, lo + 1), len(offsets) - 1)
        part = data[offsets[lo]:offsets[hi]]
        yield _words(lo, part, offsets[lo:hi + 1] - offsets[lo], kind)
        lo = hi


def _words(first: int, data: np.ndarray, offsets: np.ndarray, kind: Words) -> Block:
    if kind is not Words.SPACED:
        data = _LOWER[data]
    inside = (_ALNUM if kind is Words.ALNUM else _SPACED)[data]
    edge = np.zeros(len(data) + 1, bool)  # a text begins here
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    sums = np.zeros(len(data) + 1, U64)
    sums[1:] = _byte_values()[data]
    sums[1:] *= _powers(_BASE, len(data))
    np.cumsum(sums[1:], out=sums[1:])
    return Block(first, len(offsets) - 1, data, offsets, starts, ends, np.searchsorted(starts, offsets),
                 _span_hashes(sums, starts, ends), sums)


def _span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    shift = _powers(_BASE_INV, len(sums) + 1)[starts]
    return mix((sums[ends] - sums[starts]) * shift + (ends - starts).astype(U64))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of n consecutive words, by start; text borders are the caller's matter."""
    if len(hashes) < n:
        return np.zeros(0, U64)
    step, out = U64(0xD6E8FEB86659FD93), np.zeros(len(hashes) - n + 1, U64)
    for j in range(n):
        out = out * step + hashes[j:len(hashes) - n + 1 + j]
    return mix(out + U64(n))


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the keys that occur twice or more, and of those equal to an earlier one."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, later
