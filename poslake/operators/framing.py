"""M1: cut a chunked byte stream back into whole JSON objects.

Objects are found by brace depth; braces inside strings (and ``\\"``) do not
count; a partial object waits for the next chunk.  Fixed here (quirk Q10):
the unfinished tail is kept exactly (not located by text search), and a
stray ``}`` at depth 0 is ignored instead of driving the depth negative.

``reassemble_parallel`` (the batch job) frames all segments of all sessions
in parallel through a prefix scan of per-segment summaries (below), so a
session holding a third of all chunks is not one task.  ``reassemble`` is
the plain ordered scan (one scanner per session, memory bounded by one open
object) kept as the reference.  The streaming job keeps the scanner state
per session in ``applyInPandasWithState``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

_SPECIAL = re.compile(r'[{}"\\]')


@dataclass
class Framer:
    """Scanner state for one stream: depth, string/escape flags, open object."""

    depth: int = 0
    in_string: bool = False
    escape: bool = False
    start_seq: int | None = None
    start_off: int | None = None
    parts: list[str] = field(default_factory=list)

    def feed(self, seq: int, text: str):
        """Consume one chunk; yield (start_seq, start_off, json) per object."""
        if not text:
            return
        begin = 0 if self.depth > 0 else None  # where the open object resumes
        for m in _SPECIAL.finditer(text):
            i, ch = m.start(), m.group()
            if self.in_string:
                if self.escape:
                    self.escape = False
                elif ch == "\\":
                    self.escape = True
                elif ch == '"':
                    self.in_string = False
                continue
            if ch == '"':
                self.in_string = True
            elif ch == "{":
                if self.depth == 0:
                    self.start_seq, self.start_off = seq, i
                    self.parts = []
                    begin = i
                self.depth += 1
            elif ch == "}":
                if self.depth == 0:
                    continue  # stray brace: ignored
                self.depth -= 1
                if self.depth == 0:
                    self.parts.append(text[begin:i + 1])
                    yield self.start_seq, self.start_off, "".join(self.parts)
                    self.parts, begin = [], None
                    self.start_seq = self.start_off = None
        if self.depth > 0 and begin is not None:
            self.parts.append(text[begin:])

    # State round trip for the streaming operator.
    def to_state(self) -> tuple:
        return (self.depth, self.in_string, self.escape, self.start_seq, self.start_off,
                "".join(self.parts))

    @classmethod
    def from_state(cls, st) -> "Framer":
        f = cls(int(st[0]), bool(st[1]), bool(st[2]),
                None if st[3] is None else int(st[3]), None if st[4] is None else int(st[4]))
        f.parts = [st[5]] if st[5] else []
        return f


OBJECT_FIELDS = [T.StructField("start_seq", T.LongType()),
                 T.StructField("start_offset", T.LongType()),
                 T.StructField("json", T.StringType())]
FRAMER_STATE = T.StructType([
    T.StructField("depth", T.LongType()), T.StructField("in_string", T.BooleanType()),
    T.StructField("escape", T.BooleanType()), T.StructField("start_seq", T.LongType()),
    T.StructField("start_offset", T.LongType()), T.StructField("tail", T.StringType())])


def reassemble(chunks: DataFrame, key=("msg_request_id",), order: str = "chunk_seq",
               text: str = "chunk") -> DataFrame:
    """Batch M1: (key..., chunk order, chunk text) → (key..., start_seq,
    start_offset, json).  An object left open at the end of a session is not
    emitted (the reader would still be waiting for it)."""
    key = list(key)
    schema = T.StructType([chunks.schema[k] for k in key] + OBJECT_FIELDS)

    def frame(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, framer = None, Framer()
        for pdf in batches:
            out = []
            keys = pdf[key].itertuples(index=False, name=None)
            for k, seq, chunk in zip(keys, pdf[order].tolist(), pdf[text].tolist()):
                if k != current:
                    current, framer = k, Framer()
                for s, off, obj in framer.feed(int(seq), chunk or ""):
                    out.append((*k, s, off, obj))
            if out:
                yield pd.DataFrame(out, columns=schema.names)

    ordered = chunks.select(*key, order, text).repartition(*key) \
        .sortWithinPartitions(*key, order)
    return ordered.mapInPandas(frame, schema)


# ---------------------------------------------------------------------------
# Parallel framing: a prefix scan over fixed-width segments of each session.
#
# The lexer (normal / in string / after backslash) does not depend on depth,
# and clamped depth changes compose as d ↦ max(d + b, a).  So each segment
# is summarised once per possible entry lexer state — exit state, (b, a), and
# the candidate top-level object starts with the deepest entry depth at which
# each would still start an object — without knowing its real entry.  Those
# small summaries are composed per session to get every segment's exact entry
# (lexer state, depth, open object); then all segments are framed in
# parallel and only objects that cross a segment border are regrouped.

SEGMENT_WIDTH = 4096  # chunk_seq units per segment: a segment holds ≤ this many chunks
FRAME_ROWS = 256  # pieces that a task sends on at a time


def _summarise(seqs, texts, s0: int):
    """(exit lexer state, b, a, frontier[(threshold, seq, offset)]) for entry state s0."""
    state, b, a = s0, 0, 0
    frontier: list[tuple[int, int, int]] = []
    for seq, text in zip(seqs, texts):
        for m in _SPECIAL.finditer(text or ""):
            ch = m.group()
            if state == 2:
                state = 1
            elif state == 1:
                if ch == "\\":
                    state = 2
                elif ch == '"':
                    state = 0
            elif ch == '"':
                state = 1
            elif ch == "{":
                if a == 0:  # depth before is 0 iff entry depth ≤ -b
                    t = -b
                    while frontier and frontier[-1][0] <= t:
                        frontier.pop()
                    frontier.append((t, int(seq), m.start()))
                b, a = b + 1, a + 1
            elif ch == "}":
                b, a = b - 1, max(a - 1, 0)
    return state, b, a, frontier


SUMMARY_SCHEMA = T.StructType([
    T.StructField("seg", T.LongType()),
    *[f for s in range(3) for f in (
        T.StructField(f"x{s}", T.IntegerType()), T.StructField(f"b{s}", T.LongType()),
        T.StructField(f"a{s}", T.LongType()),
        T.StructField(f"f{s}", T.ArrayType(T.ArrayType(T.LongType()))))]])
ENTRY_FIELDS = [T.StructField("seg", T.LongType()), T.StructField("e_state", T.IntegerType()),
                T.StructField("e_depth", T.LongType()), T.StructField("e_start_seq", T.LongType()),
                T.StructField("e_start_off", T.LongType())]
PIECE_FIELDS = [T.StructField("start_seq", T.LongType()), T.StructField("start_offset", T.LongType()),
                T.StructField("piece_seq", T.LongType()), T.StructField("piece_off", T.LongType()),
                T.StructField("opens", T.BooleanType()), T.StructField("closes", T.BooleanType()),
                T.StructField("text", T.StringType())]


def _frame_segment(seqs, texts, state: int, depth: int, start):
    """Scan one segment from a known entry; yield pieces of objects."""
    cur = start if depth > 0 else None
    for seq, text in zip(seqs, texts):
        text = text or ""
        begin = 0 if depth > 0 else None
        opened_here = False
        for m in _SPECIAL.finditer(text):
            i, ch = m.start(), m.group()
            if state == 2:
                state = 1
                continue
            if state == 1:
                if ch == "\\":
                    state = 2
                elif ch == '"':
                    state = 0
                continue
            if ch == '"':
                state = 1
            elif ch == "{":
                if depth == 0:
                    cur, begin, opened_here = (int(seq), i), i, True
                depth += 1
            elif ch == "}" and depth > 0:
                depth -= 1
                if depth == 0:
                    yield (*cur, int(seq), begin, opened_here, True, text[begin:i + 1])
                    cur, begin, opened_here = None, None, False
        if depth > 0 and begin is not None:
            yield (*cur, int(seq), begin, opened_here, False, text[begin:])


def _runs(batches, cols):
    """Yield (group key, {col: list}) for runs of equal group key across sorted
    Arrow batches (the group's rows are contiguous after the sort)."""
    cur, acc = None, None
    for pdf in batches:
        lists = {c: pdf[c].tolist() for c in pdf.columns}
        gkeys = list(zip(*[lists[c] for c in cols]))
        n = len(gkeys)
        i = 0
        while i < n:
            j = i
            while j < n and gkeys[j] == gkeys[i]:
                j += 1
            if gkeys[i] != cur:
                if acc is not None:
                    yield cur, acc
                cur, acc = gkeys[i], {c: [] for c in lists}
            for c in lists:
                acc[c].extend(lists[c][i:j])
            i = j
    if acc is not None:
        yield cur, acc


def _segments(chunks: DataFrame, key: list[str], order: str, text: str, width: int) -> DataFrame:
    seg = F.floor(F.col(order) / F.lit(width)).cast("long").alias("seg")
    return chunks.select(*key, seg, F.col(order).cast("long").alias(order), F.col(text).alias(text))


def _summaries(segmented: DataFrame, key: list[str], order: str, text: str) -> DataFrame:
    """Step 1: per-segment summaries for each possible entry lexer state."""
    gk = [*key, "seg"]
    schema = T.StructType([segmented.schema[k] for k in key] + list(SUMMARY_SCHEMA.fields))

    def summarise(batches):
        out = []
        for g, acc in _runs(batches, gk):
            row = list(g)
            for s in range(3):
                x, b, a, fr = _summarise(acc[order], acc[text], s)
                row += [x, b, a, [list(t) for t in fr]]
            out.append(row)
            if len(out) >= 4096:
                yield pd.DataFrame(out, columns=schema.names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=schema.names)

    return segmented.repartition(*gk).sortWithinPartitions(*gk, order).mapInPandas(summarise, schema)


def _entries(summaries: DataFrame, key: list[str], ends: bool = False) -> DataFrame:
    """Step 2: compose summaries per session, in segment order (one row per segment).

    ``ends`` adds a row of segment ``END`` for each session: the state after its last segment."""
    schema = T.StructType([summaries.schema[k] for k in key] + ENTRY_FIELDS)

    def compose(batches):
        # Streams through the sorted summaries, carrying the running entry
        # across rows and batches: a session's summaries are never held at once.
        cur, state, depth, start = None, 0, 0, None

        def row(seg):
            return [*cur, seg, state, depth, *(start or (None, None))]

        for pdf in batches:
            cols = {c: pdf[c].tolist() for c in pdf.columns}
            out = []
            for i in range(len(pdf)):
                k = tuple(cols[c][i] for c in key)
                if k != cur:
                    if ends and cur is not None:
                        out.append(row(END))
                    cur, state, depth, start = k, 0, 0, None
                out.append(row(int(cols["seg"][i])))
                x, b, a = cols[f"x{state}"][i], cols[f"b{state}"][i], cols[f"a{state}"][i]
                fr = cols[f"f{state}"][i]
                local = None
                for t, sq, off in reversed(list(fr) if fr is not None else []):
                    if t >= depth:
                        local = (int(sq), int(off))
                        break
                new_depth = max(depth + int(b), int(a))
                start = (local or start) if new_depth > 0 else None
                state, depth = int(x), new_depth
            if out:
                yield pd.DataFrame(out, columns=schema.names)
        if ends and cur is not None:
            yield pd.DataFrame([row(END)], columns=schema.names)

    return summaries.repartition(*key).sortWithinPartitions(*key, "seg").mapInPandas(compose, schema)


def _pieces(segmented: DataFrame, entries: DataFrame, key: list[str], order: str, text: str) -> DataFrame:
    """Step 3: frame every segment from its exact entry, in parallel."""
    gk = [*key, "seg"]
    schema = T.StructType([segmented.schema[k] for k in key] + PIECE_FIELDS)

    def frame(batches):
        out = []
        for g, acc in _runs(batches, gk):
            es = acc["e_start_seq"][0]
            start = None if es is None or pd.isna(es) else (int(es), int(acc["e_start_off"][0]))
            for p in _frame_segment(acc[order], acc[text], int(acc["e_state"][0]),
                                    int(acc["e_depth"][0]), start):
                out.append([*g[:len(key)], *p])
            if len(out) >= FRAME_ROWS:  # between segments: a task holds one segment's pieces
                yield pd.DataFrame(out, columns=schema.names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=schema.names)

    return (segmented.join(entries, gk, "inner").repartition(*gk)
            .sortWithinPartitions(*gk, order).mapInPandas(frame, schema))


def _objects(whole: DataFrame, parts: DataFrame, key: list[str]) -> DataFrame:
    """Step 4: objects inside one piece pass through; the rest are regrouped by id, but
    only those that close: an object left open would gather its whole session."""
    ids = [*key, "start_seq", "start_offset"]
    parts = parts.join(parts.where("closes").select(*ids).distinct(), ids, "left_semi")
    glued = (parts.groupBy(*ids)
             .agg(F.sort_array(F.collect_list(F.struct("piece_seq", "piece_off", "text")))
                  .alias("_p"), F.bool_or("closes").alias("_closed"),
                  F.bool_or("opens").alias("_opened"))
             .where(F.col("_closed") & F.col("_opened"))
             .select(*ids, F.array_join(F.transform("_p", lambda p: p["text"]), "").alias("json")))
    return whole.select(*ids, F.col("text").alias("json")).unionByName(glued)


def _in_one_piece() -> Column:
    return F.col("opens") & F.col("closes")


def reassemble_parallel(chunks: DataFrame, key=("msg_request_id",), order: str = "chunk_seq",
                        text: str = "chunk", width: int = SEGMENT_WIDTH) -> DataFrame:
    """Batch M1 as a parallel prefix scan (same output as ``reassemble``).

    Every Python step runs in ``mapInPandas`` over partitions hashed by
    (session, segment) and sorted within, so one call handles many segments
    and no group is larger than one segment (or one session's summaries)."""
    key = list(key)
    segmented = _segments(chunks, key, order, text, width)
    entries = _entries(_summaries(segmented, key, order, text), key)
    # Written once: both branches below read the pieces, and framing runs once.
    pieces = cut(_pieces(segmented, entries, key, order, text))
    return _objects(pieces.where(_in_one_piece()), pieces.where(~_in_one_piece()), key)


# ---------------------------------------------------------------------------
# The scan across micro-batches.

END = (1 << 63) - 1  # stands after every segment of a session
BORDER_FIELDS = ENTRY_FIELDS[1:]


@dataclass
class Carried:
    """What is open between two batches.

    ``border``: one row per session that stands inside an object or a string: key, lexer state, depth and where
    its open object starts.  ``open``: the pieces of the open objects, a row for each chunk, so neither grows into one
    long value."""

    border: DataFrame
    open: DataFrame

    @classmethod
    def schemas(cls, chunks: DataFrame, key) -> tuple[T.StructType, T.StructType]:
        ks = [chunks.schema[k] for k in key]
        return T.StructType(ks + BORDER_FIELDS), T.StructType(ks + PIECE_FIELDS)

    @classmethod
    def nothing(cls, chunks: DataFrame, key=("msg_request_id",)) -> "Carried":
        spark = chunks.sparkSession
        return cls(*[spark.createDataFrame([], s) for s in cls.schemas(chunks, key)])


def _border_summaries(border: DataFrame, key: list[str]) -> DataFrame:
    """A session's state as the summary of a segment before all others: from the empty start it leads there."""
    start = F.when(F.col("e_start_seq").isNull(), F.array().cast("array<array<bigint>>")).otherwise(
        F.array(F.array(F.lit(0).cast("bigint"), "e_start_seq", "e_start_off")))
    return border.select(*key, F.lit(-1).cast("bigint").alias("seg"), *[
        c for s in range(3) for c in (F.col("e_state").alias(f"x{s}"), F.col("e_depth").alias(f"b{s}"),
                                      F.col("e_depth").alias(f"a{s}"), start.alias(f"f{s}"))])


@dataclass
class FramedBatch:
    objects: DataFrame   # as of ``reassemble``: those that close in this batch
    carried: Carried
    active: DataFrame    # sessions that had chunks in this batch


def frame_batch(chunks: DataFrame, carried: Carried, key=("msg_request_id",), order: str = "chunk_seq",
                text: str = "chunk", width: int = SEGMENT_WIDTH) -> FramedBatch:
    """M1 for one micro-batch after others of the same sessions.

    The batch's segments are summarised and framed in parallel as in ``reassemble_parallel``; only the small summaries of
    a session meet, behind its border state.  Chunks of a session come in order from batch to batch (within a batch
    in any order), sequence numbers are not negative; null text is empty.  Batches framed one after the other give
    together what ``reassemble`` gives for all chunks."""
    key = list(key)
    segmented = _segments(chunks, key, order, text, width)
    summaries = _summaries(segmented, key, order, text).unionByName(_border_summaries(carried.border, key))
    entries = cut(_entries(summaries, key, ends=True))
    border = entries.where((F.col("seg") == END) & ((F.col("e_depth") > 0) | (F.col("e_state") > 0))).drop("seg")
    inside = entries.where((F.col("seg") >= 0) & (F.col("seg") < END))
    pieces = cut(_pieces(segmented, inside, key, order, text))
    parts = carried.open.unionByName(pieces.where(~_in_one_piece()))
    still = border.where("e_depth > 0").select(*key, F.col("e_start_seq").alias("start_seq"), F.col("e_start_off").alias("start_offset"))
    left_open = parts.join(still, [*key, "start_seq", "start_offset"], "left_semi").select(*carried.open.columns)
    return FramedBatch(_objects(pieces.where(_in_one_piece()), parts, key), Carried(border, left_open),
                       inside.select(*key).distinct())
