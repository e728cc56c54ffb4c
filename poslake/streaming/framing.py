"""Streaming M1 by ``frame_batch``: one session's micro-batch is framed by several tasks.

What is carried from batch to batch lies in a folder, a version for each batch: ``border`` (one small row per session
that stands inside an object) and ``open`` (the pieces of the open objects).  Version N is written before the batch
counts as done and is read by batch N + 1.  A batch that is run again starts from version N - 1 once more, brings
the same objects, and leaves a committed version N as it is; version N - 2 goes when N is committed.

A session that stands between objects has no state.  One that stays inside an object without a chunk for
``idle_seconds`` is given up: its state goes, its open object is listed in ``expired`` and chunks that still come
are read as a new stream.

Defined cases: an empty batch carries everything on; the folder belongs to one streaming query, another one (a new
checkpoint) or a gap in the versions is refused; ``on_objects`` may see a batch again and must overwrite by batch id.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..operators.framing import SEGMENT_WIDTH, Carried, frame_batch
from ..session import cut
from ..sources.tables import _fs

SEEN = T.StructField("seen_at", T.DoubleType())


@dataclass
class SessionFraming:
    """The ``foreachBatch`` function; ``on_objects(objects, batch_id)`` takes what closes in a batch."""

    root: str
    on_objects: Callable[[DataFrame, int], None]
    key: tuple[str, ...] = ("msg_request_id",)
    order: str = "chunk_seq"
    text: str = "chunk"
    width: int = SEGMENT_WIDTH
    idle_seconds: float | None = None
    clock: Callable[[], float] = time.time

    def __call__(self, chunks: DataFrame, batch_id: int) -> None:
        spark, key = chunks.sparkSession, list(self.key)
        versions = self._versions(spark)
        if any(v > batch_id for v in versions):
            raise RuntimeError(f"{self.root} holds state after batch {batch_id}: it belongs to another streaming query")
        if batch_id and batch_id - 1 not in versions:
            raise RuntimeError(f"{self.root} holds no state of batch {batch_id - 1}")
        border, pieces = self._read(chunks, batch_id - 1) if batch_id else self._nothing(chunks)
        framed = frame_batch(cut(chunks), Carried(border.drop(SEEN.name), pieces), key, self.order, self.text, self.width)
        self.on_objects(framed.objects, batch_id)
        if batch_id not in versions:
            self._write(framed, border, batch_id)
        self._forget(spark, [v for v in versions if v < batch_id - 1])

    def expired(self, spark: SparkSession) -> DataFrame:
        """Open objects given up so far: key, start_seq, start_offset, seen_at, n_chars, batch."""
        return spark.read.option("basePath", f"{self.root}/expired").parquet(f"{self.root}/expired")

    # -- versions ----------------------------------------------------------
    def _path(self, kind: str, batch_id: int) -> str:
        return f"{self.root}/{kind}/batch={batch_id}"

    def _versions(self, spark: SparkSession) -> list[int]:
        """Batches whose border is committed: it is written last."""
        fs, p, jvm = _fs(spark, f"{self.root}/border")
        if not fs.exists(p):
            return []
        found = [s.getPath() for s in fs.listStatus(p)]
        return [int(d.getName().split("=")[1]) for d in found if fs.exists(jvm.org.apache.hadoop.fs.Path(d, "_SUCCESS"))]

    def _forget(self, spark: SparkSession, versions: list[int]) -> None:
        for v in versions:
            for kind in ("border", "open"):  # the border is what commits a version: it goes first
                fs, p, _ = _fs(spark, self._path(kind, v))
                fs.delete(p, True)

    def _schemas(self, chunks: DataFrame) -> tuple[T.StructType, T.StructType]:
        border, pieces = Carried.schemas(chunks, self.key)
        return T.StructType([*border.fields, SEEN]), pieces

    def _nothing(self, chunks: DataFrame) -> tuple[DataFrame, ...]:
        return tuple(chunks.sparkSession.createDataFrame([], s) for s in self._schemas(chunks))

    def _read(self, chunks: DataFrame, batch_id: int) -> tuple[DataFrame, ...]:
        read = chunks.sparkSession.read
        return tuple(read.schema(s).parquet(self._path(kind, batch_id))
                     for kind, s in zip(("border", "open"), self._schemas(chunks), strict=True))

    def _write(self, framed, before: DataFrame, batch_id: int) -> None:
        key, now = list(self.key), F.lit(float(self.clock()))
        seen = framed.active.withColumn("_now", F.lit(True))
        border = (framed.carried.border.join(before.select(*key, SEEN.name), key, "left").join(seen, key, "left")
                  .withColumn(SEEN.name, F.when(F.col("_now"), now).otherwise(F.coalesce(SEEN.name, now))).drop("_now"))
        pieces = framed.carried.open
        if self.idle_seconds is not None:
            border = cut(border)
            idle = F.col(SEEN.name) < now - self.idle_seconds
            given_up = border.where(idle)
            border = border.where(~idle)
            starts = given_up.select(*key, F.col("e_start_seq").alias("start_seq"), F.col("e_start_off").alias("start_offset"), SEEN.name)
            chars = pieces.groupBy(*key).agg(F.sum(F.length("text")).alias("n_chars"))
            starts.join(chars, key, "left").write.mode("overwrite").parquet(self._path("expired", batch_id))
            pieces = pieces.join(given_up.select(*key), key, "left_anti")
        pieces.write.mode("overwrite").parquet(self._path("open", batch_id))
        border.write.mode("overwrite").parquet(self._path("border", batch_id))


def frame_stream(chunks: DataFrame, root: str, on_objects: Callable[[DataFrame, int], None], checkpoint: str,
                 **options) -> DataStreamWriter:
    """The writer of a chunk stream; ``root`` keeps what is open between batches."""
    return chunks.writeStream.foreachBatch(SessionFraming(root, on_objects, **options)).option("checkpointLocation", checkpoint)
