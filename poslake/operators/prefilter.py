"""Which rows may hold a key of a set: a bitmap of the keys' hashes, of bounded size, that goes to every task.

A keyed join shuffles both sides whole, also where few rows match.  The bitmap tells rows that cannot match
before the shuffle; those that may match still go through the exact join, so a false hit costs work and
never changes a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

BITS = 1 << 28       # all flags: 32 MB in every task when full
WORDS = 64           # 64-bit words in one row of the bitmap
ROW_BITS = 64 * WORDS


def key_hash(columns) -> Column:
    """A hash of key columns that tells null from every value."""
    columns = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.xxhash64(*[x for c in columns for x in (c.isNull(), c)])


def bitmap(hashes: DataFrame, column: str = "_hash") -> DataFrame:
    """The bitmap of a hash column: one row per part that holds a key.  Written once, so plans that use it stay small."""
    slot = F.pmod(F.col(column), F.lit(BITS))
    word = F.shiftright(slot, 6)
    words = (hashes.where(F.col(column).isNotNull())
             .select(word.alias("_word"), F.expr(f"shiftleft(1L, CAST(pmod(`{column}`, 64) AS INT))").alias("_bit"))
             .groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))
    return cut(words.groupBy(F.shiftright("_word", 6).alias("_part"))
               .agg(F.map_from_entries(F.collect_list(F.struct(F.pmod("_word", F.lit(WORDS)).cast("int"), "_bits"))).alias("_m"))
               .select("_part", F.expr(f"transform(sequence(0, {WORDS - 1}), i -> coalesce(_m[i], 0L))").alias("_words")))


def repeated(hashes: DataFrame, column: str = "_hash") -> DataFrame:
    """The bitmap of the hashes that occur more than once: rows outside it share their key with no other row."""
    return bitmap(hashes.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), column)


def may_hold(rows: DataFrame, hash_of: Column, bits: DataFrame, name: str = "_hit") -> DataFrame:
    """``rows`` with a flag: false where no key of ``bits`` can equal the row's (a null hash never does)."""
    slot = F.pmod(hash_of, F.lit(BITS))
    at = rows.withColumn("_slot_at", slot)
    joined = at.join(F.broadcast(bits), F.shiftright("_slot_at", 12) == F.col("_part"), "left")
    flag = F.expr(f"coalesce(getbit(get(_words, CAST(pmod(shiftright(_slot_at, 6), {WORDS}) AS INT)), CAST(pmod(_slot_at, 64) AS INT)) = 1, false)")
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], flag.alias(name))
