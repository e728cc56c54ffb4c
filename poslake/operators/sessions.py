"""Subscription targets and their sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def target_status(metrics: DataFrame, targets: DataFrame) -> DataFrame:
    """M9: every session plus every configured target without one (zeros).

    ``metrics``: one row per session (entity_type, entity_name, counters);
    ``targets``: (entity_type, entity_name).  Sorted started first, then type,
    then name ignoring case (the result has one row per session/target)."""
    m = metrics.select(F.col("load_bb_entity_type").alias("entity_type"),
                       F.col("load_bb_entity_name").alias("entity_name"),
                       "heartbeats", "intraday_objects", "initial_objects", "last_message_at",
                       F.lit(True).alias("_started"))
    t = targets.select("entity_type", "entity_name").distinct()
    j = m.join(t, ["entity_type", "entity_name"], "full_outer")
    out = j.select(
        "entity_type", "entity_name",
        F.coalesce(F.col("_started"), F.lit(False)).alias("started"),
        F.coalesce("heartbeats", F.lit(0)).cast("bigint").alias("heartbeats"),
        F.coalesce("intraday_objects", F.lit(0)).cast("bigint").alias("intraday_objects"),
        F.coalesce("initial_objects", F.lit(0)).cast("bigint").alias("initial_objects"),
        F.col("last_message_at"))
    return out.orderBy(F.col("started").desc(), "entity_type", F.lower("entity_name"))


def target_names(targets: DataFrame, entity_type: str) -> DataFrame:
    """Names of one entity type, distinct ignoring case, sorted."""
    return (targets.where(F.lower("entity_type") == entity_type.lower())
            .groupBy(F.lower("entity_name").alias("_k"))
            .agg(F.min("entity_name").alias("entity_name"))
            .orderBy("_k").select("entity_name"))


def sessions_for_targets(log: DataFrame, targets: DataFrame) -> DataFrame:
    """The messages of configured targets only (one run per target)."""
    t = targets.select(F.col("entity_type").alias("load_bb_entity_type"),
                       F.col("entity_name").alias("load_bb_entity_name")).distinct()
    return log.join(t, ["load_bb_entity_type", "load_bb_entity_name"], "left_semi")
