"""Raw inbound load (S5) with field extraction (N1) and loader columns.

Each released message becomes one text row; the columns are the map's load
list (S6).  Malformed JSON goes to a quarantine frame instead (quirk Q13).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import json_field, parse_message
from ..operators.colmap import ColumnMap

LOAD_PROCESS = "stream-client"


@dataclass
class InboundLoad:
    rows: DataFrame
    quarantine: DataFrame


def loader_value(col: str, intraday: Column, account: Column) -> Column:
    """Values the loader supplies (everything else is NULL)."""
    name = col.lower()
    if name == "as_of_date":
        return F.col("as_of_date")
    if name in ("load_bb_entity_type", "load_bb_entity_name", "msg_request_id"):
        return F.col(name).cast("string")
    if name == "load_bb_action":
        return F.when(~intraday, F.lit("initial"))
    if name == "load_process":
        return F.lit(LOAD_PROCESS)
    if name == "is_intraday":
        return F.when(intraday, "true").otherwise("false")
    if name == "load_status":
        return F.when(intraday, "UPDATE").otherwise("NEW")
    if name in ("account", "account_id"):
        return account
    return F.lit(None).cast("string")


def load_inbound(messages: DataFrame, cmap: ColumnMap | None = None,
                 load_process: str = LOAD_PROCESS) -> InboundLoad:
    """Messages (with ``phase`` ∈ initial/intraday, session columns,
    ``stream_order``, ``json_stream``) → inbound text rows.

    Initial and intraday rows are one job: the phase is a column.  The row's
    load_order is its stream order (no global counter)."""
    cmap = cmap or ColumnMap.default()
    m = messages.withColumn("_msg", parse_message("json_stream"))
    intraday = F.col("phase") == "intraday"
    account = json_field(F.col("_msg"), "account")
    cols = []
    for src, kind in cmap.load_columns():
        if kind == "loader":
            v = loader_value(src, intraday, account)
            if src.lower() == "load_process":
                v = F.lit(load_process)
        else:
            v = json_field(F.col("_msg"), src)
        cols.append(v.alias(src))
    names = {c for c, _ in cmap.load_columns()}
    extra = []
    if "is_processed" not in names:
        extra.append(F.lit("false").alias("is_processed"))
    if "load_order" not in names:
        extra.append(F.col("stream_order").cast("bigint").alias("load_order"))
    good = m.where(F.col("_msg").isNotNull()).select(*cols, *extra)
    bad = m.where(F.col("_msg").isNull()).drop("_msg")
    return InboundLoad(good, bad)
