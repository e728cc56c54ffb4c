"""Sharding by a two-pass external shuffle.

Pass 1 scatters whole records uniformly into memory-sized buckets by a seeded hash of their content;
pass 2 draws a Fisher-Yates permutation of each bucket.  Buckets in order, then ranks in a bucket, are
a uniform random order of the whole table, which is cut into shards of equal row counts.

Defined cases: a null text counts as empty; null ids are spread by their text; copies with ids of
their own spread like any rows; rows that repeat in id and text all stay, and are told apart by their other
columns and a number, so they spread too; an empty table gives no rows; other columns travel with their record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, materialise, require, text_or_empty

BUCKET_BYTES = 64 << 20
SEED = 20240611
#: Copies of one row that one task numbers.
COPIES = 4096


def with_size(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``__size`` (UTF-8 bytes plus 1) and ``__crc`` (CRC-32 of the text)."""
    body = text_or_empty(text)
    return docs.withColumn("__size", F.octet_length(body).cast("long") + 1).withColumn("__crc", F.crc32(body.cast("binary")))


def bucket_count(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> tuple[int, int]:
    """(rows, buckets of about ``bucket_bytes``) from the sizes of all rows."""
    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("__size"), F.lit(0))).first()
    return rows, max(1, -(-size // bucket_bytes))


def spread_copies(keyed: DataFrame) -> DataFrame:
    """``keyed`` with a ``__key`` of its own for each row of keys that occur more than once.

    Equal rows are counted, and each count is laid out again as so many numbered rows, by several tasks if it is
    large: the keys do not depend on how the rows were dealt to tasks."""
    names = keyed.columns
    repeated = materialise(keyed.groupBy("__key").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("__key"))
    if repeated.isEmpty():
        return keyed
    several = keyed.join(repeated, "__key", "left_semi").groupBy(*[col(c) for c in names]).agg(F.count(F.lit(1)).alias("__n"))
    chunks = several.withColumn("__chunk", F.explode(F.expr(f"sequence(0, (__n - 1) div {COPIES})"))).repartition("__key", "__chunk")
    numbered = chunks.withColumn("__copy", F.explode(F.expr(f"sequence(__chunk * {COPIES}, least(__n, (__chunk + 1) * {COPIES}) - 1)")))
    own = F.xxhash64("__copy", *[x for c in names for x in (col(c).isNull(), col(c))])
    return keyed.join(repeated, "__key", "left_anti").unionByName(numbered.withColumn("__key", own).select(*[col(c) for c in names]))


def external_shuffle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED,
                     bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """All records with ``__size``, ``__crc``, ``__bucket`` and ``__rank`` (place in the bucket, from 0),
    and the number of rows.

    One task holds one bucket.  Its rows are put in order of (id, CRC) first, so the permutation does
    not depend on the order in which the shuffle delivers them."""
    require(docs, [doc_id, text])
    sized = with_size(docs, text)
    rows, n = bucket_count(sized, bucket_bytes)
    scattered = (spread_copies(sized.withColumn("__key", F.xxhash64(F.lit(seed), col(doc_id), F.col("__crc"), F.col("__size"))))
                 .repartition(n, "__key").withColumn("__bucket", F.spark_partition_id().cast("long")))
    schema = T.StructType([*scattered.schema.fields, T.StructField("__rank", T.LongType())])

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        bucket = pa.Table.from_batches(held)
        order = bucket.select(["__key", "__crc"]).append_column("at", pa.array(np.arange(len(bucket)))).sort_by(
            [("__key", "ascending"), ("__crc", "ascending"), ("at", "ascending")])["at"].to_numpy().copy()
        number = bucket["__bucket"][0].as_py()
        np.random.default_rng([seed, number]).shuffle(order)  # Fisher-Yates
        step = max(1, len(order) // len(held))
        for lo in range(0, len(order), step):
            part = bucket.take(pa.array(order[lo:lo + step]))
            part = part.append_column("__rank", pa.array(np.arange(lo, lo + len(part)), pa.int64()))
            yield from part.combine_chunks().to_batches()

    return scattered.mapInArrow(permute, schema).drop("__key"), rows


def place(shuffled: DataFrame, rows: int, n_shards: int = 8) -> DataFrame:
    """Adds ``__shard`` and ``__slot`` to rows with ``__bucket`` and ``__rank``.

    The running sum goes over one row per bucket.  Shard i takes the positions from ceil(i * rows /
    n_shards), so row counts are at most one apart."""
    counts = shuffled.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    at = F.col("__from") + F.col("__rank")
    exact = F.expr(f"(__pos * {n_shards}) div {max(rows, 1)}")
    first = F.expr(f"(__shard * {max(rows, 1)} + {n_shards - 1}) div {n_shards}")
    return (shuffled.join(starts, "__bucket").withColumn("__pos", at)
            .withColumn("__shard", exact.cast("int")).withColumn("__slot", F.col("__pos") - first)
            .drop("__from", "__pos"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, doc_id: str = "doc_id", text: str = "text",
                 seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Writes the shuffled records as Parquet, a folder per shard; file order and ``slot`` follow the shuffle."""
    shuffled, rows = external_shuffle(docs, doc_id, text, seed, bucket_bytes)
    placed = place(shuffled, rows, n_shards)
    out = placed.select(*[col(c) for c in docs.columns if c not in ("shard", "slot")],
                        F.col("__shard").alias("shard"), F.col("__slot").alias("slot"), "__bucket")
    (out.repartition("__bucket").sortWithinPartitions("shard", "slot").drop("__bucket")
     .write.mode("overwrite").partitionBy("shard").parquet(path))


def shard_table(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    shuffled, rows = external_shuffle(docs.select("doc_id", "text"))
    digest = materialise(shuffled.select("doc_id", "__size", "__crc", "__bucket", "__rank"))
    return place(digest, rows, n_shards).select(
        "doc_id", F.col("__size").alias("size"), F.col("__crc").cast("long").alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("__shard").alias("shard"), F.col("__slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
