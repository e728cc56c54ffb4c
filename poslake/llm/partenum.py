"""Jaccard self-join on word shingles by PartEnum signatures.

Two sets with Jaccard similarity of at least t differ in at most (1 - t) / (1 + t) * (|A| + |B|) shingles.
Sizes fall into bands [2^i, 2^(i+1)).  For the band of the smaller set the shingle domain is cut into
partitions by hash, and a set's signature for a partition is the partition with the shingles it has
there.  Of two sets that differ in at most k shingles at most k partitions differ, so if a set fills more
than k partitions the two share a signature; and, as with any two sets that differ in at most k elements,
the first k + 1 signatures of each in one common order hold a shared one.  The enumerated subsets are thus
single partitions: k + 1 signatures a set, the fewest there can be.  A set that fills k partitions or
fewer adds its k + 1 first single shingles (a partition for each shingle), which it always has.

The common order puts signatures of frequent shingles last.  Frequencies are counted over all documents
in a table of ``SLOTS`` hash slots: a fixed size, and the order affects cost only, not what is found.
Signatures with a frequent shingle are salted before they are grouped.

Copies of one set are one class.  Sets of classes with candidates are written before the rounds that compare
them, once for the first two and once for the rest.  A class keeps how many of its shingles fall in each of a row of hash cells
(about a byte for every two shingles); the sum of the smaller counts bounds an intersection from above, and
candidates that it rules out go no further.  The others are verified by exact intersection in rounds: each class
against the smallest class of a signature, that with which it shares most signatures; then the other
such pairs between components so far; then, for signatures whose classes still lie in several components,
all that is left across them.  There, classes that share most signatures with one pivot are taken together: few classes on both sides
are listed as pairs, many are compared block by block (about ``BLOCK_SHINGLES`` a side) as products of
incidence matrices, and a block gives no more links than it has classes.  A pair in one component needs no
check, so components are those of all links.

Defined cases: null counts as empty; a text without words has no shingles, links with nothing and is its
own component; fewer than n words are one shingle; documents that repeat an id keep a row each; a null id
takes part, and its component is the smallest id that is not null; an empty table gives no rows; other
columns are not kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnp
from .common import TASK_LISTS, bitmap, col, fitted, require, stored, tasks_for, text_or_empty, with_row_key
from .components import components

WORDS = 5
PERCENT = 75
SLOTS = 1 << 18
#: Bits for each wanted class in the table that tells which sets are needed, and the most bits that it has, 16 MB
#: (a false hit costs a set, no more).
WANTED_BITS, MOST_WANTED_BITS = 16, 1 << 27
SALTS = 64
#: Tasks that add up shingle counts, if there are not more cores.
MOST_COUNTS = 8
#: Classes of two pivots are listed as pairs up to so many pairs, else compared in blocks of so many shingles.
LISTED_PAIRS, BLOCK_SHINGLES = 64, 1 << 17
PIVOT_SHINGLES = 100
#: Sets that one task writes.
CLASS_SETS = 5_000
U64 = np.uint64


@dataclass(frozen=True)
class Join:
    """Shingle length, and the threshold in percent."""

    words: int = WORDS
    percent: int = PERCENT

    def distance(self, a: int, b: int) -> int:
        """Most shingles by which linked sets of sizes a and b differ."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def instances(self, size: int) -> list[tuple[int, int]]:
        """(band, most differing shingles) of each band in which a set can meet a smaller or equal one, and
        of its own, in which it can also be the smaller."""
        own = size.bit_length() - 1
        lowest = (-(-size * self.percent // 100)).bit_length() - 1
        found = [(own, self.distance(size, size * 100 // self.percent))]
        return found + [(band, self.distance(size, (2 << band) - 1)) for band in range(lowest, own)]


def _partitions(band: int) -> int:
    return (1 << band) + 16


def shingle_sets(block: textnp.Block, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    grams, out = textnp.ngrams(block.hashes, words), []
    for lo, hi in zip(block.bounds[:-1], block.bounds[1:], strict=True):
        if hi - lo >= words:
            out.append(np.unique(grams[lo:hi - words + 1]))
        else:
            out.append(textnp.ngrams(block.hashes[lo:hi], hi - lo) if hi > lo else np.zeros(0, U64))
    return out


def set_hash(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of a set; 0 only for the empty set."""
    total = textnp.mix(shingles + U64(0x51ED270B)).sum(dtype=U64) + U64(len(shingles))
    return int(textnp.mix(np.array([total], U64)).view(np.int64)[0]) or 1 if len(shingles) else 0


def signatures(shingles: np.ndarray, join: Join, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, frequency of the rarest shingle of each) of a set that is not empty."""
    seen = frequency[(shingles & U64(SLOTS - 1)).astype(np.int64)]
    found, rates = [], []
    for band, k in join.instances(len(shingles)):
        part = ((shingles >> U64(32)) * U64(_partitions(band))) >> U64(32)
        order = np.argsort(part, kind="stable")
        begins = np.flatnonzero(np.concatenate(([True], np.diff(part[order]) > 0)))
        has = np.add.reduceat(textnp.mix(shingles[order]), begins)
        sign = textnp.mix(has + textnp.mix((part[order][begins] << U64(8)) + U64(band + 1)))
        rate = np.minimum.reduceat(seen[order], begins)
        first = np.lexsort((sign, rate))[:k + 1]
        found.append(sign[first])
        rates.append(rate[first])
        if len(begins) <= k:
            sign = textnp.mix(shingles + U64(band * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            first = np.lexsort((sign, seen))[:k + 1]
            found.append(sign[first])
            rates.append(seen[first])
    return np.concatenate(found), np.concatenate(rates)


def cell_counts(shingles: np.ndarray) -> bytes:
    """Shingles in each of 16 or more hash cells, two to four a cell on average; 255 means that many or more."""
    bits = max(4, len(shingles).bit_length() - 2)
    counts = np.bincount((shingles >> U64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def most_shared(a: bytes, b: bytes) -> float:
    """An upper bound on the shingles that two sets share, from their cell counts."""
    x, y = (np.frombuffer(c, np.uint8).astype(np.float64) for c in (a, b))
    x[x == 255], y[y == 255] = np.inf, np.inf
    cells = min(len(x), len(y))  # the cells of the larger set are halves, quarters, ... of those of the smaller
    return float(np.minimum(x.reshape(cells, -1).sum(axis=1), y.reshape(cells, -1).sum(axis=1)).sum())


def document_sets(docs: DataFrame, doc_id: str, text: str, join: Join) -> DataFrame:
    """(id, n_shingles, class, cells, seen): the class is a hash of the whole set, 0 for the empty set.  Each task
    adds one row with nothing but ``seen``, its shingles counted by hash slot."""
    schema = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("n_shingles", T.LongType()),
                           T.StructField("class", T.LongType()), T.StructField("cells", T.BinaryType()), T.StructField("seen", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, ids = np.zeros(SLOTS, np.int64), None
        for batch in batches:
            ids = batch.column(0).type
            for block in textnp.blocks(batch.column(1), textnp.Words.SPACED_LOWER):
                sets = shingle_sets(block, join.words)
                seen += np.bincount((np.concatenate(sets) & U64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.n), pa.array([len(s) for s in sets], pa.int64()),
                                                  pa.array([set_hash(s) for s in sets], pa.int64()),
                                                  pa.array([cell_counts(s) for s in sets], pa.binary()), pa.nulls(block.n, pa.binary())], schema.names)
        if ids is not None:
            nothing = [pa.nulls(1, t) for t in (ids, pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*nothing, pa.array([zlib.compress(seen.tobytes(), 1)], pa.binary())], schema.names)

    return docs.select(col(doc_id), text_or_empty(text).alias("__text")).mapInArrow(run, schema)


def shingle_frequency(counted: DataFrame) -> np.ndarray:
    """Shingles by hash slot over all documents, from the ``seen`` of all tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                total += np.frombuffer(zlib.decompress(packed), np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    # As many tasks as there are cores: each gives a row for every slot, and tasks grow with the documents.
    counted = counted.select("seen").coalesce(max(MOST_COUNTS, counted.sparkSession.sparkContext.defaultParallelism))
    counts = counted.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SLOTS, np.int64)
    for row in counts:  # at most SLOTS rows
        out[row["slot"]] = row["n"]
    return out


def _per_class(docs: DataFrame, text: str, join: Join, schema: str, emit) -> DataFrame:
    """``emit(class, shingles)`` (a list of arrays) for each class that a task meets, once a task."""
    names = T._parse_datatype_string(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for block in textnp.blocks(batch.column(0), textnp.Words.SPACED_LOWER):
                rows = []
                for s in shingle_sets(block, join.words):
                    cls = set_hash(s)
                    if cls and cls not in done:
                        done.add(cls)
                        rows.append(emit(cls, s))
                rows = [r for r in rows if r is not None]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*rows, strict=True)], names)

    return docs.select(text_or_empty(text).alias("__text")).mapInArrow(run, schema)


def signature_rows(docs: DataFrame, text: str, join: Join, frequency: np.ndarray, hot: int) -> DataFrame:
    """(sign, salt, class); the salt is 0 unless even the rarest shingle is seen more than ``hot`` times."""
    def emit(cls: int, shingles: np.ndarray) -> list[pa.Array]:
        sign, rate = signatures(shingles, join, frequency)
        salt = np.where(rate > hot, 1 + cls % SALTS, 0)
        return [pa.array(sign.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(np.full(len(sign), cls, np.int64))]

    return _per_class(docs, text, join, "sign long, salt int, class long", emit)


def class_sets(docs: DataFrame, text: str, join: Join, wanted: DataFrame) -> DataFrame:
    """(class, shingles) of the ``wanted`` classes, once each: a table of bounded size, made for their number, says
    which texts to look at, and a join which of their sets to take."""
    wanted = fitted(wanted.select("class").distinct())
    n = wanted.count()
    bits = min(MOST_WANTED_BITS, 1 << max(15, (WANTED_BITS * n).bit_length()))
    packed = bitmap(wanted, "class", bits)

    def emit(cls: int, shingles: np.ndarray) -> list[pa.Array] | None:
        at = cls & (bits - 1)
        if not (packed[at >> 3] >> (at & 7)) & 1:
            return None
        values = pa.array(shingles.view(np.int64))
        return [pa.array([cls], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(shingles)], pa.int32()), values)]

    found = _per_class(docs, text, join, "class long, shingles array<bigint>", emit)
    return found.join(wanted, "class", "left_semi").dropDuplicates(["class"]).coalesce(tasks_for(n, CLASS_SETS))


def _classes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class")))


def verify(sets: DataFrame, pairs: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b) of classes whose ``sets`` reach the threshold."""
    left = sets.select(F.col("class").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("class").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (pairs.join(right, "b").join(left, "a")
            .filter(100 * both >= join.percent * (F.size("x") + F.size("y") - both)).select("a", "b"))


def _possible(pairs: DataFrame, classes: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b) whose sizes and cell counts allow the threshold; other columns stay."""
    def side(x: str) -> DataFrame:
        return classes.select(F.col("class").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("cells").alias(f"c{x}"))

    met = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("na", "nb") >= join.percent * F.greatest("na", "nb"))
    given = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, ca, cb = (batch.column(len(given) + i).to_pylist() for i in range(4))
            most = [min(x, y, most_shared(p, q)) for x, y, p, q in zip(na, nb, ca, cb, strict=True)]
            keep = [100 * m >= join.percent * (x + y - m) for m, x, y in zip(most, na, nb, strict=True)]
            yield batch.select(given).filter(pa.array(keep, pa.bool_()))

    return met.select(*given, "na", "nb", "ca", "cb").mapInArrow(run, pairs.schema)


def _across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) that lie in different components so far."""
    ra, rb = (roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in ("a", "b"))
    met = pairs.join(ra, "a", "left").join(rb, "b", "left")
    return met.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def _relabel(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Adds ``root``, the component so far, to rows with a ``class``."""
    return members.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn(
        "root", F.coalesce("root", "class"))


def links(docs: DataFrame, text: str, join: Join, frequency: np.ndarray, classes: DataFrame, n_docs: int) -> DataFrame:
    """Verified links (a, b) between classes that connect every component; ``classes`` has (class, n_shingles,
    cells)."""
    hot = int(np.median(frequency)) + max(1000, n_docs // 100)
    rows = signature_rows(docs, text, join, frequency, hot)
    by = Window.partitionBy("sign", "salt").orderBy("class")
    rows = rows.select("sign", "salt", "class", F.first("class").over(by).alias("leader"), F.lag("class").over(by).alias("prev"))
    members = fitted(rows.filter("(class <> leader and class <> prev) or (salt > 0 and prev is null)"))
    salted = members.filter("salt > 0 and class = leader")
    tops = salted.select("sign", "class", F.first("class").over(Window.partitionBy("sign").orderBy("class")).alias("leader"))
    stars = members.select("leader", "class").unionByName(tops.select("leader", "class")).filter("leader <> class")
    stars = stars.groupBy(F.col("leader").alias("a"), F.col("class").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    stars = fitted(stars)
    pivots = _pivots(stars, classes)
    stars = fitted(_possible(stars, classes, join))

    first = stars.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b")
    with stored(class_sets(docs, text, join, _classes(stars))) as sets:
        found = fitted(verify(sets, first, join))
        # A class has one link so far, to a smaller class: two steps up stand in for its component.
        above = found.select(F.col("b").alias("a"), F.col("a").alias("top"))
        roots = found.join(above, "a", "left").select(F.col("b").alias("node"), F.coalesce("top", "a").alias("root"))

        rest = fitted(_across(stars.select("a", "b"), roots).join(first, ["a", "b"], "left_anti"))
        found = found.unionByName(fitted(verify(sets, rest, join)))
    roots = fitted(components(found))

    listed, blocks = unresolved(members, pivots, roots, classes)
    listed = fitted(_possible(listed.join(stars.select("a", "b"), ["a", "b"], "left_anti"), classes, join))
    blocks = fitted(blocks)
    with stored(class_sets(docs, text, join, _classes(listed).unionByName(blocks.select("class")))) as sets:
        return (found.unionByName(fitted(verify(sets, listed, join)))
                .unionByName(fitted(compare_blocks(sets, blocks, join))))


def _pivots(stars: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, pivot): up to eight steps up, each to the leader that a class shares most signatures with, if they
    share a signature for every ``PIVOT_SHINGLES`` shingles.  Pivots only decide what is compared together."""
    best = stars.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a"), F.max("n").alias("n"))
    best = best.join(classes.select(F.col("class").alias("b"), "n_shingles"), "b").filter(
        F.col("n") * PIVOT_SHINGLES >= F.col("n_shingles"))
    best = fitted(best.select(F.col("b").alias("class"), F.col("a").alias("pivot")))
    for _ in range(3):
        above = best.select(F.col("class").alias("pivot"), F.col("pivot").alias("top"))
        best = fitted(best.join(above, "pivot", "left").select("class", F.coalesce("top", "pivot").alias("pivot")))
    return best


def _both_ways(contacts: DataFrame, left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return contacts.join(left, [*on, "p"]).join(right, [*on, "q"])


def unresolved(members: DataFrame, pivots: DataFrame, roots: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is to be compared among classes that share a signature but lie in different components: pairs (a, b),
    and rows (p, i, q, j, left, class, root) of the blocks i of pivot p and j of pivot q.

    Signatures with the same classes are one group, and groups within one component drop out first."""
    everyone = members.select("sign", "class").unionByName(members.select("sign", F.col("leader").alias("class"))).distinct()
    placed = fitted(_relabel(everyone, roots).join(pivots, "class", "left").withColumn("pivot", F.coalesce("pivot", "class")))
    groups = (placed.groupBy("sign").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"),
                                         F.min("class").alias("c"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("h"))
              .filter("lo <> hi").groupBy("n", "c", "h").agg(F.min("sign").alias("sign")).select("sign"))
    rows = fitted(placed.join(groups, "sign", "left_semi"))
    own = fitted(rows.select("class", "root", "pivot").distinct().join(classes.select("class", "n_shingles"), "class"))
    size = own.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    part = rows.groupBy("sign", "pivot").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).join(size, "pivot")
    side = lambda x: part.select("sign", *[F.col(c).alias(f"{c}{x}") for c in ("lo", "hi", "n", "blocks")], F.col("pivot").alias(x))
    contacts = fitted(side("p").join(side("q"), "sign").filter(
        "p <= q and (lop <> hip or loq <> hiq or lop <> loq)").withColumn("many", F.col("np") * F.col("nq") > LISTED_PAIRS))

    few = contacts.filter(~F.col("many")).select("sign", "p", "q")
    left = rows.select("sign", F.col("pivot").alias("p"), F.col("class").alias("x"), F.col("root").alias("rx"))
    right = rows.select("sign", F.col("pivot").alias("q"), F.col("class").alias("y"), F.col("root").alias("ry"))
    listed = (_both_ways(few, left, right, ["sign"]).filter("rx <> ry")
              .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())

    many = contacts.filter("many").select("p", "q", "blocksp", "blocksq").distinct()
    block = F.pmod(F.xxhash64("class"), F.col("own")).cast("int")
    sides = []
    for at, other, is_left in (("p", "q", True), ("q", "p", False)):
        met = many.withColumn("own", F.col(f"blocks{at}")).join(own.withColumnRenamed("pivot", at), at).withColumn("mine", block)
        met = met.withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col(f"blocks{other}") - 1)))
        i, j = ("mine", "theirs") if is_left else ("theirs", "mine")
        sides.append(met.select("p", F.col(i).alias("i"), "q", F.col(j).alias("j"), F.lit(is_left).alias("left"), "class", "root"))
    return listed, sides[0].unionByName(sides[1]).filter("p <> q or i <= j")


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``left`` shares with each of ``right``, by incidence matrices of some
    shingles at a time."""
    x, y = (np.concatenate(s) for s in (left, right))
    row_x, row_y = (np.repeat(np.arange(len(s)), [len(v) for v in s]) for s in (left, right))
    both = np.intersect1d(x, y)
    out = np.zeros((len(left), len(right)), np.float32)
    at_x, at_y = np.searchsorted(both, x), np.searchsorted(both, y)
    in_x = (at_x < len(both)) & (both[np.minimum(at_x, len(both) - 1)] == x) if len(both) else np.zeros(len(x), bool)
    in_y = (at_y < len(both)) & (both[np.minimum(at_y, len(both) - 1)] == y) if len(both) else np.zeros(len(y), bool)
    step = 2048
    for lo in range(0, len(both), step):
        mats = []
        for rows, at, inside, n in ((row_x, at_x, in_x, len(left)), (row_y, at_y, in_y, len(right))):
            take = inside & (at >= lo) & (at < lo + step)
            m = np.zeros((n, step), np.float32)
            m[rows[take], at[take] - lo] = 1
            mats.append(m)
        out += mats[0] @ mats[1].T
    return out


def _forest(links: np.ndarray) -> list[int]:
    """Positions of links (rows of two nodes) that connect what all of them connect."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    out = []
    for k, (a, b) in enumerate(links.tolist()):
        a, b = find(a), find(b)
        if a != b:
            up[a] = b
            out.append(k)
    return out


def compare_blocks(sets: DataFrame, blocks: DataFrame, join: Join) -> DataFrame:
    """Links (a, b) between the classes of the two sides of each block pair that connect all that are similar."""
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        side = [pdf[pdf["left"]], pdf[~pdf["left"]]]
        none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        if side[0].empty or side[1].empty:
            return none
        sets = [[np.asarray(v) for v in s["shingles"]] for s in side]
        n = [np.array([len(v) for v in s]) for s in sets]
        both = _shared(*sets)
        near = 100 * both >= join.percent * (n[0][:, None] + n[1][None] - both)
        near &= side[0]["root"].to_numpy()[:, None] != side[1]["root"].to_numpy()[None]
        x, y = np.nonzero(near)
        links = np.stack((side[0]["class"].to_numpy()[x], side[1]["class"].to_numpy()[y]), axis=1)
        links = links[_forest(links)]
        return pd.DataFrame({"a": links.min(axis=1), "b": links.max(axis=1)}) if len(links) else none

    return blocks.join(sets, "class").groupBy("p", "i", "q", "j").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", join: Join = Join()) -> DataFrame:
    """(id, n_shingles, class, component_id) for every row."""
    require(docs, [doc_id, text])
    whole = fitted(document_sets(docs, doc_id, text, join).withColumnRenamed(doc_id, "__id"), TASK_LISTS)
    rows = whole.filter("seen IS NULL").drop("seen")
    frequency = shingle_frequency(whole.filter("seen IS NOT NULL"))
    classes = fitted(rows.filter("class <> 0").select("class", "n_shingles", "cells").dropDuplicates(["class"]), TASK_LISTS)
    roots = components(links(docs, text, join, frequency, classes, rows.count()))
    placed = rows.drop("cells").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = placed.filter("class <> 0").groupBy("root").agg(F.min("__id").alias("component_id"))
    linked = placed.filter("class <> 0").join(least, "root")
    alone = placed.filter("class = 0").withColumn("component_id", F.col("__id"))
    order = ["__id", "n_shingles", "class", "component_id"]
    return linked.select(order).unionByName(alone.select(order)).withColumnRenamed("__id", doc_id)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", join: Join = Join()) -> DataFrame:
    """``docs`` with one row left of each group of near duplicates, that with the smallest id; of equal ids and
    of rows without one, that with the smallest row hash.  Rows without shingles stay; of rows equal in every
    column one stays."""
    keyed = with_row_key(docs)
    names = keyed.select("__row_key", text, col(doc_id).alias("__doc_id"))
    found = near_duplicates(names, "__row_key", text, join)
    ids = names.select("__row_key", "__doc_id").distinct()
    placed = fitted(found.filter("class <> 0").withColumnRenamed("component_id", "__group").select("__row_key", "__group").distinct().join(ids, "__row_key"))
    best = placed.groupBy("__group").agg(F.min_by("__row_key", F.struct(F.col("__doc_id").isNull(), "__doc_id", "__row_key")).alias("__row_key"))
    gone = fitted(placed.join(best, "__row_key", "left_anti").select("__row_key").distinct())
    return keyed.join(gone, "__row_key", "left_anti").dropDuplicates(["__row_key"]).drop("__row_key")
