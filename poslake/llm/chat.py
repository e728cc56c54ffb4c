"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

The hidden states are the roles.  A line shows the word of its speaker marker (if it opens with one), its
length class and whether it asks a question; the model learns from lines with known roles what each role
shows, who starts, and who follows whom.  Viterbi's path gives the roles, and a line is rendered as a turn
of its role with the marker taken off.

Conversations are cut into segments of at most ``SEGMENT`` lines.  For every segment the best path between
each entry and exit role is a small table; composing those gives the roles at the borders, and all segments
are then decoded at once, so one conversation may hold any share of the rows.

Defined cases: null text is an empty line without a marker; a null conversation id is one conversation;
lines are ordered by place, then by a hash of their text, nulls first, and repeated lines follow each other;
an empty table gives no rows; a model without lines takes every role as equally likely.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, materialise, require

SEGMENT = 4096
ROLES = ("assistant", "system", "user")
#: Words that may mark a speaker; what they say about the role is learned.
MARKERS = ("a", "agent", "ai", "answer", "assistant", "bot", "context", "customer", "human", "instruction", "model", "prompt", "q",
           "question", "response", "system", "user")
_MARKER = r"^\s*(?:###\s*|\*\*|\[|<\|?)?(?i:(" + "|".join(sorted(MARKERS, key=len, reverse=True)) + r"))(?:\|?>|\]|:\*\*|\*\*:|:)\s*"
#: Upper ends of the length classes, in words.
LENGTHS = (2, 5, 10, 20, 40, 80)
SMOOTH = 0.5


@dataclass
class Model:
    """Log-probabilities; rows are roles.  ``shows`` has a table for marker, length class and question."""

    start: np.ndarray
    follows: np.ndarray
    shows: list[np.ndarray]

    def emissions(self, seen: list[np.ndarray]) -> np.ndarray:
        return sum(table[:, x] for table, x in zip(self.shows, seen, strict=True)).T


def observe(text: Column) -> list[Column]:
    """Marker (0: none), length class and question mark of a line."""
    body = F.coalesce(text.cast("string"), F.lit(""))
    word = F.lower(F.regexp_extract(body, _MARKER, 1))
    marker = F.coalesce(F.array_position(F.array(*[F.lit(m) for m in MARKERS]), word), F.lit(0)).cast("int")
    words = F.size(F.array_remove(F.split(body, r"\s+"), ""))
    length = sum((F.when(words > n, 1).otherwise(0) for n in LENGTHS), F.lit(0))
    return [marker.alias("__marker"), length.cast("int").alias("__length"), F.rtrim(body).endswith("?").cast("int").alias("__asks")]


def strip_marker(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _MARKER, "")


def _log_rows(counts: np.ndarray) -> np.ndarray:
    counts = counts + SMOOTH
    return np.log(counts / counts.sum(axis=-1, keepdims=True))


def fit(lines: DataFrame, conv: str = "conv_id", place: str = "turn", role: str = "role", text: str = "text") -> Model:
    """Counts over all lines with a known role; who follows whom joins a place with the next one, after
    equal (conversation, place, role) are merged."""
    known = lines.select(F.struct(col(conv).alias("v")).alias("c"), col(place).alias("at"), col(role).alias("role"),
                         *observe(col(text))).filter(F.col("role").isin(*ROLES))
    number = {r: k for k, r in enumerate(ROLES)}
    sizes = {"__marker": len(MARKERS) + 1, "__length": len(LENGTHS) + 1, "__asks": 2}
    shows = {name: np.zeros((len(ROLES), n)) for name, n in sizes.items()}
    for r in known.groupBy("role", *sizes).agg(F.count(F.lit(1)).alias("n")).collect():  # roles x classes at most
        for name, table in shows.items():
            table[number[r["role"]], r[name]] += r["n"]
    turns = known.groupBy("c", "at", "role").agg(F.count(F.lit(1)).alias("n"))
    later = turns.select("c", (F.col("at") - 1).alias("at"), F.col("role").alias("next"), F.col("n").alias("m"))
    follows, start = np.zeros((len(ROLES), len(ROLES))), np.zeros(len(ROLES))
    for r in turns.join(later, ["c", "at"]).groupBy("role", "next").agg(F.sum(F.least("n", "m")).alias("n")).collect():
        follows[number[r["role"]], number[r["next"]]] += r["n"]
    first = turns.groupBy("c").agg(F.min_by("role", "at").alias("role"))
    for r in first.groupBy("role").agg(F.count(F.lit(1)).alias("n")).collect():
        if r["role"] is not None:
            start[number[r["role"]]] += r["n"]
    return Model(_log_rows(start), _log_rows(follows), [_log_rows(t) for t in shows.values()])


def segments(lines: DataFrame, conv: str, place: str, text: str) -> DataFrame:
    """Lines in order of (conversation, place), with ``__segment`` and ``__at`` (place in the segment).

    Ranges of that order go to tasks, so a large conversation spans several; no segment crosses a range."""
    keyed = lines.withColumn("__hash", F.xxhash64(col(text)))
    keyed = keyed.select("*", F.struct(col(conv).alias("v")).alias("__conv"), *observe(col(text)))
    ranged = keyed.repartitionByRange(col(conv), col(place), F.col("__hash")).sortWithinPartitions(col(conv), col(place), "__hash")
    ranged = ranged.withColumn("__segment", F.spark_partition_id().cast("long")).drop("__hash")
    schema = T.StructType([*ranged.schema.fields, T.StructField("__at", T.IntegerType())])
    conv_at = ranged.columns.index("__conv")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, at, last = -1, SEGMENT, None
        for batch in batches:
            numbers, places = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int32)
            for i, c in enumerate(batch.column(conv_at).field(0).to_pylist()):
                if number < 0 or at == SEGMENT or c != last:
                    number, at, last = number + 1, 0, c
                numbers[i], places[i] = number, at
                at += 1
            part = batch.column(batch.num_columns - 1).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array((part << 32) + numbers), pa.array(places)], schema.names)

    return ranged.mapInArrow(cut, schema)


def _forward(model: Model, shown: np.ndarray) -> np.ndarray:
    """Best log-probability of a segment's lines for each role of the line before and of its last line."""
    best = model.follows + shown[0]
    for row in shown[1:]:
        best = (best[:, :, None] + model.follows[None]).max(axis=1) + row
    return best


def _decode(model: Model, shown: np.ndarray, entry: np.ndarray, exit_role: int) -> np.ndarray:
    """The best path given the scores on entry and, if not negative, the role of the last line."""
    back = np.zeros(shown.shape, np.int64)
    score = entry + shown[0]
    for k in range(1, len(shown)):
        through = score[:, None] + model.follows
        back[k] = through.argmax(axis=0)
        score = through.max(axis=0) + shown[k]
    path = np.zeros(len(shown), np.int64)
    path[-1] = exit_role if exit_role >= 0 else score.argmax()
    for k in range(len(shown) - 1, 0, -1):
        path[k - 1] = back[k, path[k]]
    return path


def recover_roles(lines: DataFrame, model: Model, conv: str = "conv_id", place: str = "turn", text: str = "text") -> DataFrame:
    """``lines`` with ``__role``, ``__starts`` (a new turn begins) and ``__rendered``."""
    require(lines, [conv, place, text])
    kept = lines.columns
    cut = materialise(segments(lines, conv, place, text))
    seen = ["__marker", "__length", "__asks"]
    n = len(ROLES)

    whole = cut.groupBy("__conv").agg(F.count_distinct("__segment").alias("k"))
    many = whole.filter("k > 1").select("__conv")

    def path_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(segment, best scores from each role of the line before, or from the start, to each last role)."""
        held: list[np.ndarray] = []
        current = None
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            edges = np.flatnonzero(np.diff(columns[0], prepend=columns[0][0] - 1)) if batch.num_rows else []
            for lo, hi in zip(edges, [*edges[1:], batch.num_rows], strict=True):
                if columns[0][lo] != current and held:
                    yield _table(current, np.concatenate(held))
                    held = []
                current = columns[0][lo]
                held.append(model.emissions([x[lo:hi] for x in columns[1:]]))
        if held:
            yield _table(current, np.concatenate(held))

    def _table(segment: int, shown: np.ndarray) -> pa.RecordBatch:
        first = model.start + shown[0]
        for row in shown[1:]:
            first = (first[:, None] + model.follows).max(axis=0) + row
        return pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), pa.array([_forward(model, shown).ravel().tolist()]),
                                           pa.array([first.tolist()])], ["__segment", "best", "first"])

    tables = cut.select("__segment", *seen).mapInArrow(path_tables, "__segment long, best array<double>, first array<double>")
    order = cut.filter("__at = 0").select("__conv", "__segment").join(many, "__conv", "left_semi")

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__segment")
        score, back = np.array(pdf["first"].iloc[0]), []
        for best in pdf["best"].iloc[1:]:
            through = score[:, None] + np.array(best).reshape(n, n)
            back.append(through.argmax(axis=0))
            score = through.max(axis=0)
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path.reverse()
        return pd.DataFrame({"__segment": pdf["__segment"], "entry": [-1, *path[:-1]], "exit": path})

    borders = order.join(tables, "__segment").groupBy("__conv").applyInPandas(
        compose, "__segment long, entry int, exit int")
    joined = cut.join(borders, "__segment", "left")
    fields = [*lines.schema.fields, T.StructField("__path", T.IntegerType()), T.StructField("__new", T.BooleanType())]

    def decode(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__at")
        entry, leave = pdf["entry"].iloc[0], pdf["exit"].iloc[0]
        inner = pd.notna(entry) and entry >= 0
        shown = model.emissions([pdf[c].to_numpy() for c in seen])
        path = _decode(model, shown, model.follows[int(entry)] if inner else model.start, int(leave) if pd.notna(leave) else -1)
        before = np.concatenate(([int(entry) if inner else -1], path[:-1]))
        return pdf[kept].assign(__path=path, __new=path != before)

    found = joined.drop("__conv").groupBy("__segment").applyInPandas(decode, T.StructType(fields))
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.col("__path") + 1)
    rendered = F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), strip_marker(col(text)), F.lit("<|im_end|>\n"))
    return found.select(*[col(c) for c in kept], role.alias("__role"), F.col("__new").alias("__starts"), rendered.alias("__rendered"))


#: Markers seen in chat logs, one column per style; an empty marker leaves the line bare.
_STYLES = {"assistant": ("Assistant: ", "AI: ", "A: ", "[assistant] ", "### Response:\n", "**Assistant:** "),
           "system": ("System: ", "System: ", "Context: ", "[system] ", "### System:\n", "**System:** "),
           "user": ("User: ", "Human: ", "Q: ", "[user] ", "### Instruction:\n", "**User:** ")}


def transcript(conversations: DataFrame) -> DataFrame:
    """The conversations as raw logs: roles only show in markers, of one style a conversation, and one line in
    eight has none."""
    style = F.pmod(F.xxhash64(F.lit("style"), "conv_id"), F.lit(len(_STYLES["user"]))).cast("int")
    marker = F.lit("")
    for role, markers in _STYLES.items():
        marker = F.when(F.col("role") == role, F.element_at(F.array(*[F.lit(m) for m in markers]), style + 1)).otherwise(marker)
    bare = F.pmod(F.xxhash64(F.lit("bare"), "conv_id", "turn"), F.lit(8)) == 0
    text = F.coalesce(F.col("text"), F.lit(""))
    return conversations.select("conv_id", "turn", "role", F.when(bare, text).otherwise(F.concat(marker, text)).alias("text"))


def chat_table(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, starts_turn, rendered) for every line of the conversations' transcripts."""
    logs = transcript(conversations)
    found = recover_roles(logs.drop("role"), fit(logs))
    return found.select("conv_id", "turn", F.col("__role").alias("role"), F.col("__starts").alias("starts_turn"),
                        F.col("__rendered").alias("rendered"))
