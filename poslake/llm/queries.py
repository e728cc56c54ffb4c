"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, chat, decontam, extract, gam, licenses, linededup, merkle, packing, partenum, repetition, shards, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_table(_table(spark, sf_dir, "documents"))


def op4_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(_table(spark, sf_dir, "documents"), ["doc_id"])


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_table(_table(spark, sf_dir, "conversations"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.quality_table(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_table(_table(spark, sf_dir, "documents"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_table(_table(spark, sf_dir, "pages"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment_table(_table(spark, sf_dir, "documents"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_table(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_url_filter, op3_line_dedup, op4_repetition, op5_chat, op6_license_scan, op7_quality, op8_decontamination, op9_near_duplicates, op10_sharding,
                                   op11_html_extraction, op12_alignment, op13_manifest)}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": linededup.ORACLE_SQL}
