"""Streaming M1 and M3–M5: keyed state per session, O(1) or one open object.

``classify_stream`` tags each message with its phase.  State per session is
(max order seen, released, first heartbeat): initial rows are *not* held in
state — they flow out tagged ``initial`` and the sink parks them until the
session's ``initial_end`` marker releases them.  A row's phase follows from its
order and the first heartbeat's, as in the batch form, so initial rows may come
in any order of files.  Updates at or below the highest order already seen are
never applied; they flow out as ``late`` so that the sink can count them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.framing import FRAMER_STATE, OBJECT_FIELDS, Framer
from ..schemas import SESSION_KEY

PHASE_STATE = T.StructType([T.StructField("max_order", T.LongType()),
                            T.StructField("released", T.BooleanType()),
                            T.StructField("first_hb", T.LongType())])


def _hb(s: pd.Series) -> pd.Series:
    s = s.fillna("")
    return (s.str.len() <= 2) & (s.str.strip() == "{}")


def classify_stream(messages: DataFrame, key=SESSION_KEY, order: str = "stream_order",
                    payload: str = "json_stream") -> DataFrame:
    key = list(key)
    out_schema = T.StructType(list(messages.schema.fields)
                              + [T.StructField("phase", T.StringType()),
                                 T.StructField("released", T.BooleanType())])
    cols = messages.columns

    def fn(_key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.exists:
            max_order, released, first_hb = state.get
        else:
            max_order, released, first_hb = -1, False, None
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(order, kind="stable")
        if pdf.empty:
            return
        hb = _hb(pdf[payload]).to_numpy()
        orders = pdf[order].to_numpy()
        phase = []
        for is_hb, o in zip(hb, orders):
            if not released and is_hb:
                released, first_hb = True, int(o)
                phase.append("initial_end")
            elif not released or (not is_hb and o < first_hb):
                phase.append("initial")
            elif is_hb:
                phase.append("heartbeat")
            else:
                phase.append("late" if o <= max_order else "intraday")
        out = pdf[cols].copy()
        out["phase"] = phase
        out["released"] = released
        state.update((max(max_order, int(orders.max())), bool(released), first_hb))
        yield out

    return messages.groupBy(*key).applyInPandasWithState(
        fn, out_schema, PHASE_STATE, "append", GroupStateTimeout.NoTimeout)


def reassemble_stream(chunks: DataFrame, key=("msg_request_id",), order: str = "chunk_seq",
                      text: str = "chunk") -> DataFrame:
    """Streaming M1: the framer's state (one open object) lives in the session's
    group state; each micro-batch's chunks are fed in order."""
    key = list(key)
    out_schema = T.StructType([chunks.schema[k] for k in key] + OBJECT_FIELDS)

    def fn(k, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        framer = Framer.from_state(state.get) if state.exists else Framer()
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(order, kind="stable")
        out = []
        for seq, chunk in zip(pdf[order].tolist(), pdf[text].tolist()):
            for s, off, obj in framer.feed(int(seq), chunk or ""):
                out.append((*k, s, off, obj))
        state.update(framer.to_state())
        if out:
            yield pd.DataFrame(out, columns=out_schema.names)

    return chunks.groupBy(*key).applyInPandasWithState(
        fn, out_schema, FRAMER_STATE, "append", GroupStateTimeout.NoTimeout)
