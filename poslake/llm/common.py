"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, ensure_checkpoint_dir
from . import textnp


#: Narrow rows (ids, pairs, links) that one task reads, and rows with a list or a set.
TASK_ROWS, TASK_LISTS = 100_000, 10_000


def tasks_for(rows: int, each: int | None = None) -> int:
    return 1 + rows // (each or TASK_ROWS)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the files.

    Used where a small result is read several times, or before a loop; a lost executor then costs
    a reread and not a recomputation."""
    return cut(df)


def fitted(df: DataFrame, each: int | None = None) -> DataFrame:
    """``materialise`` in as many files as the rows ask for, ``each`` (narrow rows: ``TASK_ROWS``) in a file; later
    steps read them in as many tasks.

    The rows are computed by all tasks of their plan and wait on the executors' disks until they are counted and
    written.  Few rows in many partitions would cost more than the rows themselves: each task writes shuffle files
    of its own, and on a local file system Hadoop starts two processes for each file that it writes."""
    kept = df.persist(StorageLevel.DISK_ONLY)
    try:
        return materialise(kept.coalesce(tasks_for(kept.count(), each)))
    finally:
        kept.unpersist()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this process wrote, on whatever file system it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` as a Parquet table in the shared checkpoint folder, for columns that several steps read; the table is
    deleted at the end, so what is kept beyond must be materialised before."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    try:
        yield spark.read.parquet(path)
    finally:
        remove(spark, path)


def require(df: DataFrame, columns: Iterable[str]) -> None:
    """Raise a clear error if ``df`` lacks one of ``columns``."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")


def col(name: str) -> Column:
    """A column by its literal name (names with dots or spaces included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(name: str) -> Column:
    return F.coalesce(col(name).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; ``lower`` would also change letters outside ASCII."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_row_key(docs: DataFrame) -> DataFrame:
    """Adds ``__row_key``, a hash of all columns: equal rows share it, and rows need no id.  A hash skips nulls,
    so whether each column is null is hashed too."""
    return docs.withColumn("__row_key", F.xxhash64(*[x for c in docs.columns for x in (col(c).isNull(), col(c))]))


def map_texts(df: DataFrame, keep: list[str], text: str, kind: textnp.Words, fields: list[T.StructField],
              measure: Callable[[textnp.Block], list[np.ndarray]]) -> DataFrame:
    """``keep`` columns of every row, and the arrays that ``measure`` returns for each block of texts."""
    schema = T.StructType([*(df.schema[c] for c in keep), *fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in textnp.blocks(batch.column(len(keep)), kind):
                kept = [batch.column(i).slice(block.first, block.n) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(kept + [pa.array(x) for x in measure(block)], names)

    return df.select(*[col(c) for c in keep], text_or_empty(text).alias("__text")).mapInArrow(run, schema)


def bitmap(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A table of ``bits`` flags (a power of two, 2**15 at least), as packed bytes: which low bits of a hash
    column occur.  Its size is fixed, so it may go to every task; a false hit costs work, never results."""
    slot = F.pmod(col(column), F.lit(bits)) + 1
    parts = (hashes.select(F.bitmap_bucket_number(slot).alias("part"), F.bitmap_bit_position(slot).alias("at"))
             .groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits")).collect())
    packed = np.zeros(bits // 8, np.uint8)
    for row in parts:
        found = np.frombuffer(bytes(row["bits"]), np.uint8)
        packed[(row["part"] - 1) * len(found):row["part"] * len(found)] = found
    return packed


def in_bitmap(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which (unsigned) hashes a packed table may hold."""
    at = hashes & np.uint64(8 * len(packed) - 1)
    return (packed[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
