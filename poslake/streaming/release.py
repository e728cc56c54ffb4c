"""Streaming M3 + M4: initial rows wait in keyed state and are released by their session's first heartbeat.

``release_stream`` runs ``transformWithState`` per session.  Until the first heartbeat every row of a session is
appended to a map state in chunks of at most ``CHUNK_ROWS`` rows (so no state entry grows with the session, and no
step holds more than a chunk); the batch that brings the heartbeat emits them all with their phases, as in the
batch form.  Afterwards rows pass straight through; updates at or below the highest order already seen are ``late``.

State ends: a session without messages for ``idle_ms`` expires by a processing-time timer.  Rows that still wait
then flow out as ``expired``, followed by one ``session_end`` row, so that the sink can count both; a marker with a
time-to-live of ``closed_ms`` makes what still arrives ``late``.

Because waiting rows are part of the checkpointed state, a micro-batch that is run again emits the same rows again.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..schemas import SESSION_KEY
from .sessions import _hb

CHUNK_ROWS = 1000
DAY_MS = 24 * 3600 * 1000
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
NO_DATA_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _packed(pdf: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(pdf, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> pd.DataFrame:
    with pa.ipc.open_stream(packed) as reader:
        return reader.read_pandas()


class SessionRelease(StatefulProcessor):
    """State of a session: highest order, first heartbeat, chunks that wait, and its timer."""

    def __init__(self, columns: list[str], key: list[str], order: str, payload: str, idle_ms: int, closed_ms: int):
        self._columns, self._key, self._order, self._payload = columns, key, order, payload
        self._idle_ms, self._closed_ms = idle_ms, closed_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._session = handle.getValueState("session", "max_order long, first_hb long, chunks long, timer long")
        self._waiting = handle.getMapState("waiting", "chunk long", "rows binary")
        self._closed = handle.getValueState("closed", "at long", ttlDurationMs=self._closed_ms)

    def _wait(self, pdf: pd.DataFrame, chunks: int) -> int:
        for at in range(0, len(pdf), CHUNK_ROWS):
            self._waiting.updateValue((chunks,), (_packed(pdf[self._columns].iloc[at:at + CHUNK_ROWS]),))
            chunks += 1
        return chunks

    def _phased(self, pdf: pd.DataFrame, first_hb: int | None, late_to: int, phase: str | None = None) -> pd.DataFrame:
        out = pdf[self._columns].copy()
        if phase is None:
            order, hb = out[self._order], _hb(out[self._payload])
            told = pd.Series("intraday", index=out.index)
            told[order <= late_to] = "late"
            told[hb] = "heartbeat"
            told[order < first_hb] = "initial"
            told[order == first_hb] = "initial_end"
            out["phase"], out["released"] = told, True
        else:
            out["phase"], out["released"] = phase, False
        return out

    def _restart_timer(self, timer: int | None, now: int) -> int:
        due = now + self._idle_ms
        if due != timer:
            if timer is not None:
                self._handle.deleteTimer(timer)
            self._handle.registerTimer(due)
        return due

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not self._session.exists() and self._closed.exists():
            for pdf in rows:
                hb = _hb(pdf[self._payload])
                yield self._phased(pdf, None, 0, "late").assign(phase=hb.map({True: "heartbeat", False: "late"}))
            return
        max_order, first_hb, chunks, timer = self._session.get() if self._session.exists() else (-1, None, 0, None)
        seen, heartbeat = max_order, None
        for pdf in rows:
            if pdf.empty:
                continue
            seen = max(seen, int(pdf[self._order].max()))
            if first_hb is not None:
                yield self._phased(pdf, first_hb, max_order)
                continue
            markers = pdf.loc[_hb(pdf[self._payload]), self._order]
            if len(markers):
                heartbeat = int(markers.min()) if heartbeat is None else min(heartbeat, int(markers.min()))
            chunks = self._wait(pdf, chunks)
        if heartbeat is not None:
            for packed, in self._waiting.values():
                yield self._phased(_unpacked(packed), heartbeat, -1)
            self._waiting.clear()
            first_hb, chunks = heartbeat, 0
        timer = self._restart_timer(timer, timerValues.getCurrentProcessingTimeInMs())
        self._session.update((seen, first_hb, chunks, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for packed, in self._waiting.values():
            yield self._phased(_unpacked(packed), None, 0, "expired")
        row = dict.fromkeys(self._columns) | dict(zip(self._key, key, strict=True))
        yield pd.DataFrame([row | {"phase": "session_end", "released": False}])
        self._waiting.clear()
        self._session.clear()
        self._closed.update((timerValues.getCurrentProcessingTimeInMs(),))

    def close(self) -> None:
        pass


@contextmanager
def drained(spark: SparkSession) -> Iterator[None]:
    """Queries started within end once their source is drained; timers fire in batches that have data."""
    before = spark.conf.get(NO_DATA_BATCHES, "true")
    spark.conf.set(NO_DATA_BATCHES, "false")
    try:
        yield
    finally:
        spark.conf.set(NO_DATA_BATCHES, before)


def release_stream(messages: DataFrame, key=SESSION_KEY, order: str = "stream_order", payload: str = "json_stream",
                   idle_ms: int = DAY_MS, closed_ms: int = 7 * DAY_MS) -> DataFrame:
    """Messages with ``phase`` and ``released``, initial rows only once their session's first heartbeat is there.

    Needs the RocksDB state store, which is set here for queries that start afterwards.  A query that only drains its
    source (``availableNow``) must run under ``drained``: timers ask for one empty batch after the other."""
    key = list(key)
    messages.sparkSession.conf.set(STATE_STORE, ROCKSDB)
    schema = T.StructType([*messages.schema.fields, T.StructField("phase", T.StringType()), T.StructField("released", T.BooleanType())])
    processor = SessionRelease(messages.columns, key, order, payload, idle_ms, closed_ms)
    return messages.groupBy(*key).transformWithStateInPandas(processor, schema, "append", "ProcessingTime")
