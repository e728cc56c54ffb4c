"""Stream archive scans and replay.

The archive is an ordered table of messages per (date, entity).  All scans
are filters on the partition columns (as_of_date, entity), so they prune at
the Parquet scan; ordering is applied per session only where asked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTITY = ["as_of_date", "load_bb_entity_type", "load_bb_entity_name"]
MARKER = "{}"
END_MARKERS = 5


def read_archive(spark, path: str, as_of_date=None, entity_type=None,
                 entity_name=None) -> DataFrame:
    """Archive as Parquet partitioned by as_of_date / entity; filters prune."""
    df = spark.read.parquet(path)
    return _entity_filter(df, as_of_date, entity_type, entity_name)


def _entity_filter(df, as_of_date=None, entity_type=None, entity_name=None):
    if as_of_date is not None:
        df = df.where(F.col("as_of_date") == F.lit(as_of_date).cast("date"))
    if entity_type is not None:
        df = df.where(F.col("load_bb_entity_type") == entity_type)
    if entity_name is not None:
        df = df.where(F.col("load_bb_entity_name") == entity_name)
    return df


def in_stream_order(df: DataFrame) -> DataFrame:
    """Order rows within each entity by stream_order (no global sort: each
    entity's rows are co-located, then sorted inside their partition)."""
    return df.repartition(*ENTITY).sortWithinPartitions(*ENTITY, "stream_order")


def initial_rows(archive: DataFrame, as_of_date=None, entity_type=None,
                 entity_name=None, ordered: bool = False) -> DataFrame:
    """Initial-snapshot rows (not filtered by request id — quirk Q12)."""
    df = _entity_filter(archive, as_of_date, entity_type, entity_name)
    out = df.where(F.col("load_bb_action") == "initial")
    return in_stream_order(out) if ordered else out


def session_cursor(archive: DataFrame, as_of_date=None, entity_type=None,
                   entity_name=None) -> DataFrame:
    """S3: per (date, entity): last initial order and the request id of the
    last initial row; (0, NULL) when the entity has no initial rows."""
    df = _entity_filter(archive, as_of_date, entity_type, entity_name)
    init_order = F.when(F.col("load_bb_action") == "initial", F.col("stream_order"))
    return (df.groupBy(*ENTITY)
            .agg(F.coalesce(F.max(init_order), F.lit(0)).cast("bigint").alias("last_order"),
                 F.max_by(F.col("msg_request_id"), init_order).alias("msg_request_id")))


def updates_since(archive: DataFrame, cursor: DataFrame) -> DataFrame:
    """Rows after the cursor, same request id, action '' or NULL.

    Rows at or below the cursor are never delivered (late rows dropped)."""
    c = cursor.select(*ENTITY, F.col("last_order"), F.col("msg_request_id").alias("_req"))
    j = archive.join(c, ENTITY, "inner")
    return (j.where((F.col("stream_order") > F.col("last_order"))
                    & (F.col("msg_request_id") == F.col("_req"))
                    & (F.coalesce(F.col("load_bb_action"), F.lit("")) == ""))
            .drop("last_order", "_req"))


def session_replay(archive: DataFrame, as_of_date=None, entity_type=None,
                   entity_name=None) -> DataFrame:
    """What the server sends per entity — initial rows, then end markers
    (5 after a snapshot of any rows, 1 if there was none), then updates of the
    snapshot's request id (none if it is NULL or blank).  ``(phase, seq)``
    orders a session's output."""
    df = _entity_filter(archive, as_of_date, entity_type, entity_name)
    cur = session_cursor(df)
    counts = df.groupBy(*ENTITY).agg(
        F.count_if(F.col("load_bb_action") == "initial").alias("n_initial"))
    init = initial_rows(df).select(*ENTITY, F.lit(0).alias("phase"),
                                   F.col("stream_order").cast("bigint").alias("seq"),
                                   F.col("json_stream"))
    n_markers = F.when(F.col("n_initial") > 0, F.lit(END_MARKERS)).otherwise(1)
    markers = counts.select(*ENTITY, F.lit(1).alias("phase"),
                         F.explode(F.sequence(F.lit(1).cast("bigint"), n_markers.cast("bigint"))).alias("seq"),
                         F.lit(MARKER).alias("json_stream"))
    ups = updates_since(df, cur.where(F.col("msg_request_id").rlike("\\S"))).select(
        *ENTITY, F.lit(2).alias("phase"), F.col("stream_order").cast("bigint").alias("seq"),
        F.col("json_stream"))
    return init.unionByName(markers).unionByName(ups)
