"""Benchmark decontamination by a distributed positional inverted index.

The index holds postings (term, text, position) of training words.  A benchmark window is looked up by its
rarest terms: their lists, shifted by each term's place in the item, meet where the whole window may stand
(text, item, offset).  Such an alignment is then compared word by word, which gives exact phrase matches;
alignments whose offsets differ by a few words give proximity matches, for which every alignment counts,
those of a single term too.

Term frequencies come from all documents, by hash slot (a table of fixed size that only chooses which terms
are looked up first).  Only terms that some window asks for are stored; a bitmap of fixed size says which.
Texts with the same words are indexed under one key, once a task, and joined back to their documents.

Defined cases: null has no words; a text or item without words matches nothing; an item shorter than a
window is one window; equal items all count, by id; an item without id hits but is not listed; documents
that repeat an id keep a row each; empty tables give no matches; other columns are not kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnp
from .common import TASK_LISTS, bitmap, col, fitted, in_bitmap, map_texts, require, text_or_empty

WINDOW = 13
#: Terms looked up for each window.
RAREST = 3
FREQUENCY_SLOTS = 1 << 16
TERM_BITS = 1 << 20
TEXT_BITS = 1 << 23
SALTS = 8
#: A proximity match: offsets at most so far apart, and so many percent of the item's looked-up terms.
SLOP, NEAR_PERCENT = 4, 80


def keyed_texts(texts: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, n_words, key): the key is a hash of the word sequence, 0 if there are no words."""
    def measure(block: textnp.Block) -> list[np.ndarray]:
        n = np.diff(block.bounds).astype(np.int64)
        return [n, np.where(n > 0, block.sequence_hashes().view(np.int64), 0)]

    fields = [T.StructField("n_words", T.LongType()), T.StructField("key", T.LongType())]
    return map_texts(texts, [id_column], text, textnp.Words.ALNUM, fields, measure)


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))


def word_lists(texts: DataFrame, text: str, wanted: np.ndarray | None = None) -> DataFrame:
    """(key, words) of each distinct text with words; only those in the bitmap ``wanted`` if given."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for block in textnp.blocks(batch.column(0), textnp.Words.ALNUM):
                keys = block.sequence_hashes()
                take = np.diff(block.bounds) > 0
                if wanted is not None:
                    take &= in_bitmap(wanted, keys)
                chosen = [i for i in np.flatnonzero(take) if not (int(keys[i]) in done or done.add(int(keys[i])))]
                if chosen:
                    lists = pa.concat_arrays([_lists(block.hashes[lo:hi], np.array([0, hi - lo]))
                                              for lo, hi in ((block.bounds[i], block.bounds[i + 1]) for i in chosen)])
                    yield pa.RecordBatch.from_arrays([pa.array(keys[chosen].view(np.int64)), lists], ["key", "words"])

    found = texts.select(text_or_empty(text).alias("__text")).mapInArrow(run, "key long, words array<bigint>")
    return found.dropDuplicates(["key"])


def term_frequencies(docs: DataFrame, text: str, items: DataFrame) -> np.ndarray:
    """How often the words of each hash slot stand in all documents, for slots that the items use."""
    used = bitmap(items.select(F.explode("words").alias("term")), "term", FREQUENCY_SLOTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(FREQUENCY_SLOTS, np.int64)
        for batch in batches:
            for block in textnp.blocks(batch.column(0), textnp.Words.ALNUM):
                ours = block.hashes[in_bitmap(used, block.hashes)]
                seen += np.bincount((ours & np.uint64(FREQUENCY_SLOTS - 1)).astype(np.int64), minlength=FREQUENCY_SLOTS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["slot", "n"])

    counts = (docs.select(text_or_empty(text).alias("__text")).mapInArrow(run, "slot long, n long")
              .groupBy("slot").agg(F.sum("n").alias("n")).collect())
    out = np.zeros(FREQUENCY_SLOTS, np.int64)
    for row in counts:  # at most FREQUENCY_SLOTS rows
        out[row["slot"]] = row["n"]
    return out


def lookups(items: DataFrame, frequency: np.ndarray, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """(term, item, place, n_terms): the rarest terms of each window of each item, and how many of them an
    alignment must have."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words.values.to_numpy(zero_copy_only=False)
                rate = frequency[words & (FREQUENCY_SLOTS - 1)]
                views = np.lib.stride_tricks.sliding_window_view(rate, min(window, len(words)))
                order = np.argsort(views, axis=1, kind="stable")[:, :rarest]
                at = np.unique(order + np.arange(len(views))[:, None])
                rows.append((words[at], np.full(len(at), key), at, np.full(len(at), min(rarest, len(words))),
                             np.full(len(at), len(at))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*rows, strict=True)],
                                                 ["term", "item", "place", "need", "n_terms"])

    return items.select("key", "words").mapInArrow(run, "term long, item long, place long, need long, n_terms long")


def postings(docs: DataFrame, text: str, terms: np.ndarray) -> DataFrame:
    """(term, text, pos) of the words in the bitmap ``terms``; a task indexes equal texts once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for block in textnp.blocks(batch.column(0), textnp.Words.ALNUM):
                keys = block.sequence_hashes()
                fresh = np.array([not (k in done or done.add(k)) for k in keys.tolist()], bool)
                owner = block.owner
                at = np.flatnonzero(in_bitmap(terms, block.hashes) & fresh[owner])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.hashes[at].view(np.int64)), pa.array(keys[owner[at]].view(np.int64)),
                     pa.array((at - block.bounds[owner[at]]).astype(np.int64))], ["term", "text", "pos"])

    return docs.select(text_or_empty(text).alias("__text")).mapInArrow(run, "term long, text long, pos long")


def met_places(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(text, item, offset, place, need, n_terms): the looked-up terms of items that stand in texts.

    A frequent term's list is salted by text, and the few lookups are repeated for each salt."""
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt")
    spread = index.withColumn("salt", F.pmod(F.col("text"), F.lit(SALTS)).cast("int"))
    return (spread.join(wanted.select("*", salts), ["term", "salt"])
            .select("text", "item", (F.col("pos") - F.col("place")).alias("offset"), "place", "need", "n_terms"))


def alignments(met: DataFrame, slop: int = SLOP, percent: int = NEAR_PERCENT) -> DataFrame:
    """(text, item, offset, near) of ``met_places``: the offsets at which as many terms meet as an exact window
    needs, and a row with ``near`` (its offset is null) if ``percent`` of the item's looked-up terms stand at
    offsets at most ``slop`` apart.

    A term counts once at an offset, however many tasks indexed the text, and once in a group of offsets.  The
    rows of a text and item are sorted by Spark and judged together, so a task holds one pair and one batch."""
    def judge(rows: list[np.ndarray]) -> pa.RecordBatch:
        text, item, place, offset, need, terms = rows
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
        fresh = new.copy()  # rows come by (text, item, place, offset); equal ones are copies
        fresh[1:] |= (place[1:] != place[:-1]) | (offset[1:] != offset[:-1])
        pair = (np.cumsum(new) - 1)[fresh]
        text, item, place, offset, need, terms = (x[fresh] for x in (text, item, place, offset, need, terms))
        by = np.lexsort((offset, pair))
        first = np.flatnonzero(np.diff(pair[by], prepend=-1) | (np.diff(offset[by], prepend=0) != 0))
        n = np.diff(first, append=len(by))
        exact = by[first][n >= need[by[first]]]
        # A place is in the group that starts at s if s - 1 is at or after its offset before, and s within slop of this.
        again = np.zeros(len(pair), bool)
        again[1:] = (pair[1:] == pair[:-1]) & (place[1:] == place[:-1])
        opens = offset - slop
        opens[1:] = np.where(again[1:], np.maximum(opens[1:], offset[:-1] + 1), opens[1:])
        at, step = np.concatenate((opens, offset + 1)), np.repeat([1, -1], len(pair))
        both = np.concatenate((pair, pair))
        by = np.lexsort((step, at, both))  # a pair's steps add up to 0; groups close before others open
        held = np.cumsum(step[by])
        heads = np.flatnonzero(np.diff(pair, prepend=-1))
        most = np.maximum.reduceat(held, 2 * heads) if len(heads) else held
        near = heads[100 * most >= percent * terms[heads]]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((text[exact], text[near]))), pa.array(np.concatenate((item[exact], item[near]))),
             pa.array(np.concatenate((offset[exact], np.zeros(len(near), np.int64))), pa.int64(),
                      mask=np.repeat([False, True], [len(exact), len(near)])),
             pa.array(np.repeat([False, True], [len(exact), len(near)]))], ["text", "item", "offset", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []  # rows of the pair that is not yet closed
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            last = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
            cut = int(np.argmax(last))  # rows are sorted, so the last pair is a tail
            if kept and cut == 0 and kept[-1][0][-1] == rows[0][0] and kept[-1][1][-1] == rows[1][0]:
                kept.append(rows)
                continue
            closed = kept + [[x[:cut] for x in rows]]
            yield judge([np.concatenate(x) for x in zip(*closed, strict=True)])
            kept = [[x[cut:] for x in rows]]
        if kept:
            yield judge([np.concatenate(x) for x in zip(*kept, strict=True)])

    rows = (met.repartition("text", "item").sortWithinPartitions("text", "item", "place", "offset")
            .select("text", "item", "place", "offset", "need", "n_terms"))
    return rows.mapInArrow(run, "text long, item long, offset long, near boolean")


def exact_phrases(found: DataFrame, texts: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(text, item, start, stop): maximal runs of at least a window of an item's words in a text.

    ``found`` has alignments, ``texts`` and ``items`` the words by key."""
    lengths = items.select(F.col("key").alias("item"), F.size("words").alias("m"))
    cut = (found.select("text", "item", "offset").join(lengths, "item")
           .join(texts.select(F.col("key").alias("text"), "words"), "text")
           .select("text", "item", "offset", F.slice("words", F.greatest("offset", F.lit(0)) .cast("int")+ 1,
                                                     F.greatest(F.col("m") + F.least("offset", F.lit(0)), F.lit(0)).cast("int")).alias("part")))
    rows = cut.join(items.select(F.col("key").alias("item"), "words"), "item").select("text", "item", "offset", "part", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for text, item, offset, part, words in zip(*(c.to_pylist() if i < 3 else c for i, c in enumerate(batch.columns)), strict=True):
                part, words = (x.values.to_numpy(zero_copy_only=False) for x in (part, words))
                skip = max(0, -offset)
                same = np.concatenate(([False], words[skip:skip + len(part)] == part, [False]))
                edges = np.flatnonzero(same[1:] != same[:-1])
                for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                    if hi - lo >= min(window, len(words)):
                        out.append((text, item, offset + skip + lo, offset + skip + hi))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)],
                                                 ["text", "item", "start", "stop"])

    return rows.mapInArrow(run, "text long, item long, start long, stop long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, n_near) for every document."""
    require(docs, [doc_id, text])
    require(benchmark, [item_id, item_text])
    items = fitted(word_lists(benchmark, item_text), TASK_LISTS)
    names = keyed_texts(benchmark, item_id, item_text).filter("key <> 0").select(F.col("key").alias("item"), col(item_id).cast("string").alias("__item_id"))
    wanted = fitted(lookups(items, term_frequencies(docs, text, items), window))
    index = postings(docs, text, bitmap(wanted, "term", TERM_BITS))
    met = fitted(alignments(met_places(index, wanted)))
    found = met.filter("NOT near")
    texts = word_lists(docs, text, bitmap(found, "text", TEXT_BITS)).join(found.select(F.col("text").alias("key")).distinct(), "key", "left_semi")
    hits = fitted(exact_phrases(found, texts, items, window))

    earlier = Window.partitionBy("text").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("text", "start", "stop").distinct().withColumn("reached", F.coalesce(F.max("stop").over(earlier), F.lit(0)))
    n_hit = spans.groupBy("text").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "reached"))).alias("n_hit"))
    listed = hits.select("text", "item").distinct().join(names, "item").groupBy("text").agg(F.array_sort(F.collect_set("__item_id")).alias("ids"))
    near = met.filter("near").groupBy("text").agg(F.count(F.lit(1)).alias("n_near"))
    by_text = n_hit.join(listed, "text", "left").join(near, "text", "full").withColumnRenamed("text", "key")
    rows = keyed_texts(docs, doc_id, text).join(fitted(by_text, TASK_LISTS), "key", "left")
    n_hit, ids = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("ids", F.array().cast("array<string>"))
    return rows.select(col(doc_id), "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
                       F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
                       ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
                       F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))
