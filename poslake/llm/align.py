"""Alignment of two tokenizers over the same texts by interval coalescing.

Tokens of A (a byte-level BPE file) and B (a piece model with byte fallback) are intervals of the bytes of
space + text.  All tokens of a block of texts are sorted by start at once; a running maximum of their ends tells
where a group breaks (a start that reaches it), and within groups every A token is expanded against the B tokens
that it overlaps.  A link is an overlap whose two tokens end together.

How often an id pair is linked is counted over the corpus.  Of two tokens that end together the shorter one's
bytes end the longer one's, so the pairs that can occur are known from the vocabularies: at most one for each
suffix of each token, about half a million.  That is a proven bound on the table of counts, which is summed per
task before it is shuffled and then goes to every task as one array.  Texts are tokenized once: what the second
pass needs, the links of each text, is written to the shared checkpoint folder.

Defined cases: null and empty texts have no tokens, and so have texts that either tokenizer doesn't give back
byte by byte (A's and B's joined bytes must be those of space + text); strings of special tokens are plain text; ids may be
null or repeat, every row is a text of its own; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import tokens
from .common import col, materialise, require

#: Bytes of text that are sorted together; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20


def piece_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class PlainEncoder(tokens.Encoder):
    """Ids of A, with the strings of special tokens taken as text."""

    def __init__(self, path: str):
        super().__init__(path)
        self._tokenizer.encode_special_tokens = True
        self._special = []

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode(text), "<u4")

    def vocabulary(self) -> dict[int, bytes]:
        to_byte = tokens._byte_of_character()
        special = set(self._tokenizer.get_added_tokens_decoder())
        return {n: bytes(to_byte[c] for c in token) for token, n in self._tokenizer.get_vocab().items() if n not in special}


class PieceEncoder:
    """Ids of B, which itself puts a space before the text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        self._model = SentencePieceProcessor(model_file=path)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)

    def vocabulary(self) -> dict[int, bytes]:
        model = self._model
        pieces = {n: model.id_to_piece(n) for n in range(model.get_piece_size()) if not (model.is_control(n) or model.is_unknown(n) or model.is_unused(n))}
        return {n: bytes([int(p[3:-1], 16)]) if model.is_byte(n) else p.replace("▁", " ").encode() for n, p in pieces.items()}


@dataclass
class Vocabulary:
    """Token bytes by id, and the pairs that can be linked, as sorted keys."""

    a: list[bytes]
    b: list[bytes]
    a_lengths: np.ndarray
    b_lengths: np.ndarray
    pairs: np.ndarray


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) << 32) | b.astype(np.int64)


def linkable(a: dict[int, bytes], b: dict[int, bytes]) -> np.ndarray:
    """Keys of the id pairs of which one token's bytes end the other's, sorted."""
    found = set()
    for shorter, longer, swap in ((b, a, False), (a, b, True)):
        by_bytes: dict[bytes, list[int]] = {}
        for n, token in shorter.items():
            by_bytes.setdefault(token, []).append(n)
        for n, token in longer.items():
            for start in range(len(token)):
                for m in by_bytes.get(token[start:], ()):
                    found.add((m << 32 | n) if swap else (n << 32 | m))
    return np.array(sorted(found), np.int64)


def _listed(tokens_by_id: dict[int, bytes]) -> list[bytes]:
    return [tokens_by_id.get(n, b"") for n in range(max(tokens_by_id) + 1)]


_LOADED: dict[tuple[str, str], tuple[PlainEncoder, PieceEncoder, Vocabulary]] = {}


def load(a_path: str, b_path: str) -> tuple[PlainEncoder, PieceEncoder, Vocabulary]:
    """Both tokenizers, once for each worker process."""
    if (a_path, b_path) not in _LOADED:
        a, b = PlainEncoder(a_path), PieceEncoder(b_path)
        of_a, of_b = a.vocabulary(), b.vocabulary()
        la, lb = _listed(of_a), _listed(of_b)
        lengths = [np.fromiter(map(len, x), np.int64, len(x)) for x in (la, lb)]
        _LOADED[a_path, b_path] = a, b, Vocabulary(la, lb, *lengths, linkable(of_a, of_b))
    return _LOADED[a_path, b_path]


def coalesce(starts: np.ndarray, ends: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): intervals of both sides by start, and the group of each in that order.  A group breaks
    where a start reaches the greatest end so far."""
    order = np.lexsort((side, starts))
    if not len(order):
        return order, np.zeros(0, np.int64)
    reach = np.maximum.accumulate(ends[order])
    breaks = np.concatenate(([True], starts[order][1:] >= reach[:-1]))
    return order, np.cumsum(breaks) - 1


def overlaps(a_starts: np.ndarray, a_ends: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (A token, B token) with common bytes; each side is in order and without overlaps of its own."""
    first = np.searchsorted(b_ends, a_starts, "right")
    stop = np.maximum(np.searchsorted(b_starts, a_ends, "left"), first)
    n = stop - first
    a = np.repeat(np.arange(len(a_starts)), n)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


@dataclass
class Aligned:
    """The tokens of a block of texts: ids, the text of each, group of each, and all overlaps."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_text: np.ndarray
    b_text: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    over_a: np.ndarray
    over_b: np.ndarray
    together: np.ndarray
    n_groups: np.ndarray


def align_block(texts: list[str | None], a: PlainEncoder, b: PieceEncoder, vocabulary: Vocabulary) -> Aligned:
    """Groups and overlaps of the tokens of ``texts``."""
    n = len(texts)
    a_ids, b_ids, sizes = [], [], np.zeros(n, np.int64)
    pieces = iter(b.ids([t for t in texts if t]))
    empty = np.zeros(0, np.int64)
    for i, text in enumerate(texts):
        one, two = empty, empty
        if text:
            want = b" " + text.encode()
            one, two = a.ids(" " + text), next(pieces)
            if b"".join([vocabulary.a[x] for x in one.tolist()]) == want == b"".join([vocabulary.b[x] for x in two]):
                sizes[i] = len(want)
            else:
                one, two = empty, empty
        a_ids.append(one)
        b_ids.append(np.asarray(two, np.int64))
    a_text, b_text = (np.repeat(np.arange(n), [len(x) for x in ids]) for ids in (a_ids, b_ids))
    of_a, of_b = (np.concatenate(ids).astype(np.int64) if n else empty for ids in (a_ids, b_ids))
    # tokens tile their texts, and texts follow each other
    a_ends, b_ends = np.cumsum(vocabulary.a_lengths[of_a]), np.cumsum(vocabulary.b_lengths[of_b])
    a_starts, b_starts = a_ends - vocabulary.a_lengths[of_a], b_ends - vocabulary.b_lengths[of_b]
    side = np.repeat(np.array([0, 1], np.int8), (len(of_a), len(of_b)))
    order, group = coalesce(np.concatenate((a_starts, b_starts)), np.concatenate((a_ends, b_ends)), side)
    groups = np.empty(len(order), np.int64)
    groups[order] = group
    text_of_group = np.empty(int(group[-1]) + 1 if len(group) else 0, np.int64)
    text_of_group[groups] = np.concatenate((a_text, b_text))
    over_a, over_b = overlaps(a_starts, a_ends, b_starts, b_ends)
    return Aligned(of_a, of_b, a_text, b_text, groups[:len(of_a)], groups[len(of_a):], over_a, over_b, a_ends[over_a] == b_ends[over_b],
                   np.bincount(text_of_group, minlength=n))


class _Written:
    """Decimal ids with the character that follows them."""

    def __init__(self, vocabulary: Vocabulary):
        self._parts = [f"{n}{after}" for after in ",|,;" for n in range(max(len(vocabulary.a), len(vocabulary.b)))]
        self._size = max(len(vocabulary.a), len(vocabulary.b))

    def groups(self, found: Aligned, n: int) -> list[str]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
        last_a, last_b = (np.concatenate((g[1:] != g[:-1], [True])) if len(g) else np.zeros(0, bool) for g in (found.a_group, found.b_group))
        code = np.concatenate((found.a_ids + self._size * last_a, found.b_ids + self._size * (2 + last_b)))
        side = np.repeat(np.array([0, 1], np.int8), (len(found.a_ids), len(found.b_ids)))
        order = np.lexsort((side, np.concatenate((found.a_group, found.b_group))))
        stops = np.cumsum(np.bincount(found.a_text, minlength=n) + np.bincount(found.b_text, minlength=n))
        code, parts, out, at = code[order].tolist(), self._parts, [], 0
        for stop in stops.tolist():
            out.append("".join([parts[c] for c in code[at:stop]])[:-1])
            at = stop
        return out


def _blocks(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of blocks of about ``BLOCK_BYTES``."""
    first, held, size = 0, [], 0
    for i in range(len(texts)):
        text = texts[i].as_py()
        if held and size + len(text or "") > BLOCK_BYTES:
            yield first, held
            first, held, size = i, [], 0
        held.append(text)
        size += len(text or "")
    if held:
        yield first, held


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """One row for each text: id, ``n_a``, ``n_b``, ``n_groups``, ``n_overlaps``, ``groups_sha256`` and ``links`` (binary: the
    places in the sorted table of linkable pairs, 32-bit)."""
    require(docs, (doc_id, text))
    a_path, b_path = a_path or tokens.default_path(), b_path or piece_path()
    fields = [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_overlaps")]
    schema = T.StructType([docs.schema[doc_id], *fields, T.StructField("groups_sha256", T.StringType()), T.StructField("links", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, vocabulary = load(a_path, b_path)
        written = _Written(vocabulary)
        for batch in batches:
            for first, texts in _blocks(batch.column(1)):
                n = len(texts)
                found = align_block(texts, a, b, vocabulary)
                link_a, link_b = found.over_a[found.together], found.over_b[found.together]
                places = np.searchsorted(vocabulary.pairs, pair_key(found.a_ids[link_a], found.b_ids[link_b])).astype("<i4")
                stops = np.cumsum(np.bincount(found.a_text[link_a], minlength=n))
                links = [places[s:e].tobytes() for s, e in zip(np.concatenate(([0], stops[:-1])), stops, strict=True)]
                sums = [sha256(s.encode()).hexdigest() if s else "" for s in written.groups(found, n)]
                counts = [np.bincount(x, minlength=n) for x in (found.a_text, found.b_text)] + [found.n_groups, np.bincount(found.a_text[found.over_a], minlength=n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), *map(pa.array, counts), pa.array(sums, pa.string()), pa.array(links, pa.binary())], schema.names)

    return docs.select(col(doc_id), col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame, n_pairs: int) -> np.ndarray:
    """How many links hold each linkable pair, over all rows: at most ``n_pairs`` rows reach the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_pairs, np.int64)
        for batch in batches:
            for links in batch.column(0):
                places = np.frombuffer(links.as_py(), "<i4")
                np.add.at(total, places, 1) if len(places) < n_pairs // 64 else np.add(total, np.bincount(places, minlength=n_pairs), out=total)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["place", "n"])

    summed = aligned.select("links").mapInArrow(count, "place long, n long").groupBy("place").agg({"n": "sum"}).toArrow()
    counts = np.zeros(n_pairs, np.int64)
    counts[summed.column(0).to_numpy()] = summed.column(1).to_numpy()
    return counts


def best_pairs(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which pairs have the highest count of their B id."""
    b = pairs & 0xFFFFFFFF
    highest = np.zeros(int(b.max(initial=0)) + 1, np.int64)
    np.maximum.at(highest, b, counts)
    return counts == highest[b]


def alignment_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """One row for each text: token, group and link numbers, ``n_best`` and ``count_sum`` over the links by their
    pair's count in the corpus, and the digest of the groups."""
    aligned = materialise(align(docs, doc_id, text, a_path, b_path))
    pairs = load(a_path or tokens.default_path(), b_path or piece_path())[2].pairs
    counts = pair_counts(aligned, len(pairs))
    # both arrays have one entry for each linkable pair: a bound set by the vocabularies
    shared = docs.sparkSession.sparkContext.broadcast((counts, best_pairs(pairs, counts)))
    kept = [doc_id, "n_a", "n_b", "n_groups"]
    schema = T.StructType([*(aligned.schema[c] for c in kept), *(T.StructField(c, T.LongType()) for c in ("n_links", "n_best", "count_sum")),
                           T.StructField("groups_sha256", T.StringType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, best = shared.value
        for batch in batches:
            links = [np.frombuffer(x.as_py(), "<i4") for x in batch.column("links")]
            found = [[len(x) for x in links], [int(best[x].sum()) for x in links], [int(total[x].sum()) for x in links]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(x, pa.int64()) for x in found), batch.column("groups_sha256")], schema.names)

    return aligned.select(*[col(c) for c in kept], "groups_sha256", "links").mapInArrow(judge, schema)
