"""The training-data pipeline over ``documents``: five stages, each one of the operators of poslake.llm.

quality classifier -> line dedup -> n-gram Jaccard join -> benchmark decontamination -> best-fit packing.
Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
for the next.  All but the last return the columns of documents.

Defined cases: other columns of documents pass through; rows without an id are documents like any other;
rows equal in every column are one document from the join on; empty tables stay empty.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poslake.llm import decontam, gam, linededup, packing, partenum
from poslake.llm.common import col, remove, with_row_key
from poslake.session import ensure_checkpoint_dir, store


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects (score under its threshold)."""
    model = gam.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return gam.score(docs, model, docs.columns).filter("__predicted = 1").select(*[col(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops boilerplate lines of a source from its documents; ``n_chars`` follows the text that is left."""
    found = linededup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.when(F.col("__dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return found.select(*[col(c) for c in docs.columns])


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the one with the smallest id.  Documents without
    words link with nothing and stay."""
    return partenum.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark windows cover a twentieth or more of the words."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = with_row_key(docs)
    judged = decontam.decontaminate(keyed, benchmark, doc_id="__row_key").filter("contaminated").select("__row_key").distinct()
    # Stored first, so that Spark knows how few they are and need not shuffle and sort whole documents to meet them.
    return keyed.join(store(judged), "__row_key", "left_anti").select(*[col(c) for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left: one row per piece."""
    return packing.pack_documents(docs)


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("n-gram Jaccard join", jaccard_join),
          ("benchmark decontamination", decontamination), ("best-fit packing", best_fit_packing)]

#: The classifier's score and the tokenizer have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage returns is written under the shared checkpoint folder, and deleted
    when the next stage is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = os.path.join(folder, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            remove(spark, os.path.join(folder, f"stage{k - 1}"))
    return docs
