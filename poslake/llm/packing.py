"""Best-fit packing after dominance reduction.

Lengths are whole numbers up to the capacity, so the instance is a table of at most ``capacity`` counts
however many pieces there are.  On it the driver

1. fixes, from the longest down, sets of one to three lengths that provably dominate every other set
   that could hold the longest (Martello and Toth's reduction), many equal sets at a time, until no pass
   fixes more;
2. packs what is left by best fit, longest first, again many equal sequences at a time.

Both give patterns: so many sequences, each with these lengths.  Spark numbers the pieces of each length
and every piece finds its sequence and offset from its number alone.

Defined cases: null counts as empty, and an empty document is its end token; ids may be null or repeat;
pieces of equal length are interchangeable and numbered by a hash of their content; an empty table gives
no rows; other columns are not kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import col, materialise, require, text_or_empty

CAPACITY = 1024
END_ID = 2
#: Pieces that share a numbering bucket, about.
BUCKET_ROWS = 100_000

PIECES = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
                       T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])


@dataclass
class Pattern:
    """``bins`` sequences, each with ``lengths[w]`` pieces of length w."""

    bins: int
    lengths: dict[int, int] = field(default_factory=dict)


class Counts:
    """How many pieces of each length are left."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.n = np.zeros(capacity + 1, np.int64)
        for w, n in counts.items():
            self.n[w] += n

    def smallest(self, k: int) -> list[int]:
        found: list[int] = []
        for w in np.flatnonzero(self.n):
            found += [int(w)] * min(k - len(found), int(self.n[w]))
            if len(found) == k:
                break
        return found

    def largest_upto(self, most: int) -> int:
        left = np.flatnonzero(self.n[:max(most, 0) + 1])
        return int(left[-1]) if len(left) else 0

    def best_pair(self, room: int) -> tuple[int, int]:
        """Lengths (a, b), a >= b, of two pieces with the largest sum up to ``room``."""
        best, sizes = (0, 0), np.flatnonzero(self.n)
        for a in sizes[sizes < room]:
            b = self.largest_upto(min(int(a), room - int(a)))
            if b == a and self.n[a] < 2:
                b = self.largest_upto(int(a) - 1)
            if b and a + b > sum(best):
                best = (int(a), b)
        return best


def _dominating(left: Counts, w: int) -> tuple[list[int], int]:
    """Partners whose set with a piece of length w dominates all others, and how many such sets can be
    fixed at once; ``([], 0)`` if none is proven.  ``left`` lacks the piece itself."""
    room, same = left.capacity - w, int(left.n[w]) + 1
    small = left.smallest(3)
    if not small or small[0] > room:
        return [], same
    one = left.largest_upto(room)
    pairs = same // 2 if one == w else min(same, int(left.n[one]))
    if one == room or len(small) < 2 or small[0] + small[1] > room:
        return [one], pairs
    if len(small) == 3 and sum(small) <= room:
        return [], 0
    a, b = left.best_pair(room)
    if one >= a + b:
        return [one], pairs
    if one == a:
        between = Counts({}, left.capacity)
        between.n[b + 1:a] = left.n[b + 1:a]
        near = between.smallest(2)
        if len(near) < 2 or w + sum(near) > left.capacity:
            if w in (a, b):
                return [a, b], 1
            return [a, b], min(same, int(left.n[a]) // 2 if a == b else min(int(left.n[a]), int(left.n[b])))
    return [], 0


def reduce_by_dominance(left: Counts) -> list[Pattern]:
    """Fixes dominating sets and takes their pieces out of ``left``."""
    fixed: list[Pattern] = []
    progress = True
    while progress:
        progress = False
        for w in range(left.capacity, 0, -1):
            while left.n[w]:
                left.n[w] -= 1
                partners, bins = _dominating(left, w)
                left.n[w] += 1
                if not bins:
                    break
                pattern = Pattern(bins)
                for x in [w, *partners]:
                    left.n[x] -= bins
                    pattern.lengths[x] = pattern.lengths.get(x, 0) + 1
                fixed.append(pattern)
                progress = True
    return fixed


def best_fit(left: Counts) -> list[Pattern]:
    """Packs all of ``left``, longest first, each piece where the least room remains."""
    open_by_room: list[list[Pattern]] = [[] for _ in range(left.capacity + 1)]

    def put(pattern: Pattern, room: int, w: int, each: int) -> None:
        open_by_room[room - w * each].append(Pattern(pattern.bins, pattern.lengths | {w: each}))

    for w in range(left.capacity, 0, -1):
        n = int(left.n[w])
        for room in range(w, left.capacity + 1):
            waiting, each = open_by_room[room], room // w
            while n and waiting:
                pattern = waiting.pop()
                full = min(pattern.bins, n // each)
                if full:
                    put(Pattern(full, pattern.lengths), room, w, each)
                    n -= full * each
                rest = pattern.bins - full
                if rest and n:  # fewer than ``each`` are left
                    put(Pattern(1, pattern.lengths), room, w, n)
                    n, rest = 0, rest - 1
                if rest:
                    waiting.append(Pattern(rest, pattern.lengths))
        each = left.capacity // w
        if n // each:
            put(Pattern(n // each), left.capacity, w, each)
        if n % each:
            put(Pattern(1), left.capacity, w, n % each)
        left.n[w] = 0
    return [p for waiting in open_by_room for p in waiting]


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    left = Counts(counts, capacity)
    return reduce_by_dominance(left) + best_fit(left)


@dataclass
class Slots:
    """Where the pieces of each length go, by their number; rows sorted by (length, first number)."""

    key: np.ndarray
    base: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    low: np.ndarray

    SHIFT = 44

    @classmethod
    def of(cls, patterns: list[Pattern]) -> Slots:
        taken: dict[int, int] = {}
        rows, sequence = [], 0
        for p in patterns:
            offset = 0
            for w, each in p.lengths.items():
                low = taken.get(w, 0)
                rows.append(((w << cls.SHIFT) + low, sequence, each, offset, low))
                taken[w] = low + p.bins * each
                offset += w * each
            sequence += p.bins
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        return cls(*table.T)

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces."""
        at = np.searchsorted(self.key, (length << self.SHIFT) + number, "right") - 1
        nth = number - self.low[at]
        return self.base[at] + nth // self.each[at], self.offset[at] + nth % self.each[at] * length


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
           end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """The id column and ``PIECES``: documents over ``capacity`` are cut, the shorter piece first."""
    require(docs, [doc_id, text])
    path = path or tokens.default_path()
    schema = T.StructType([docs.schema[doc_id], *PIECES.fields])
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path).encode
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows: list[tuple[int, int, int, int, int]] = []
                for i, raw in enumerate(map(encode, part.column(1).to_pylist())):
                    raw += end
                    n = len(raw) // 4
                    at, first = 0, n % capacity or capacity
                    piece = 0
                    while at < n:
                        stop = first if not at else at + capacity
                        rows.append((i, piece, at, stop - at, zlib.crc32(raw[4 * at:4 * stop])))
                        at, piece = stop, piece + 1
                owner, *rest = (np.array(x) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(owner)), pa.array(rest[0], pa.int32()),
                     *(pa.array(x, pa.int64()) for x in rest[1:])], schema.names)

    return docs.select(col(doc_id), text_or_empty(text).alias("__text")).mapInArrow(run, schema)


def pack(cut: DataFrame, capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length``; as few sequences as the method finds.

    The driver gets at most ``capacity`` counts.  Pieces of one length are numbered in buckets, so a
    length that a third of all pieces share is spread over many tasks."""
    cut = materialise(cut)
    sizes = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(w > capacity or w < 1 for w in sizes):
        raise ValueError(f"lengths must lie in 1..{capacity}")
    slots = Slots.of(solve(sizes, capacity))
    buckets = max(1, -(-sum(sizes.values()) // bucket_rows))
    own = [col(c) for c in cut.columns]
    spread = cut.withColumn("__bucket", F.pmod(F.xxhash64(*own), F.lit(buckets)).cast("int"))
    starts = (spread.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
              .select("length", "__bucket", F.coalesce(F.sum("__n").over(
                  Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)),
                  F.lit(0)).alias("__start")))
    by = Window.partitionBy("length", "__bucket").orderBy(*own)
    numbered = spread.withColumn("__row", F.row_number().over(by)).join(starts, ["length", "__bucket"]).select(
        *own, (F.col("__start") + F.col("__row") - 1).alias("__number"))
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at = cut.columns.index("length")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = slots.find(b.column(at).to_numpy(), b.column(b.num_columns - 1).to_numpy())
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(x, pa.int64()) for x in found)], schema.names)

    return numbered.mapInArrow(assign, schema)


def pack_documents(docs: DataFrame) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs))
