"""Message and session operators over an ordered message log (M2–M6).

Batch form: each session's phase depends only on where its first heartbeat
is, so the session state is one aggregate (``min`` order of a heartbeat)
joined back — no per-session running window, so a session holding a third
of all messages is reduced map-side instead of landing in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import parse_message
from ..schemas import SESSION_KEY

ORDER = "stream_order"
PAYLOAD = "json_stream"
ZERO_FIELD = "POSITION_WITHOUT_PENDING"

# Number shapes the feed may use for zero: sign on either side, brackets,
# thousands separators, decimals and an exponent, around zeros only.
ZERO_TEXT = r"^\s*\(?\s*[-+]?\s*[0,]*\.?0*([eE][-+]?[0-9]+)?\s*[-+]?\s*\)?\s*$"
HAS_ZERO_DIGIT = r"^[^eE]*0"


def is_heartbeat(payload: Column | str = PAYLOAD) -> Column:
    """M2: a heartbeat is at most two characters and ``{}`` once trimmed."""
    p = F.col(payload) if isinstance(payload, str) else payload
    return F.coalesce((F.length(p) <= 2) & (F.trim(p) == "{}"), F.lit(False))


def first_heartbeats(log: DataFrame, key=SESSION_KEY) -> DataFrame:
    """Per session: order of the first heartbeat (NULL if none)."""
    return (log.groupBy(*key)
            .agg(F.min(F.when(is_heartbeat(), F.col(ORDER))).alias("first_hb")))


def session_phase(log: DataFrame, key=SESSION_KEY) -> DataFrame:
    """M3: ``initial`` before the first heartbeat, ``initial_end`` for it,
    then ``intraday`` payloads and ``heartbeat`` markers."""
    fh = first_heartbeats(log, key)
    j = log.join(fh, list(key), "left")
    hb = is_heartbeat()
    phase = (F.when(F.col("first_hb").isNull() | (F.col(ORDER) < F.col("first_hb")), "initial")
             .when(F.col(ORDER) == F.col("first_hb"), "initial_end")
             .when(hb, "heartbeat").otherwise("intraday"))
    return j.withColumn("phase", phase).withColumn("released", F.col("first_hb").isNotNull()) \
        .drop("first_hb")


def zero_position_excluded(payload: Column | str = PAYLOAD) -> Column:
    """M5 rule (true = drop): an empty payload, or POSITION_WITHOUT_PENDING
    missing, null, blank or a zero of any shape and size (the text is tested, so
    nothing is rounded).  Non-numeric text and malformed JSON are kept."""
    p = F.col(payload) if isinstance(payload, str) else payload

    def zero(m: Column) -> Column:
        v = F.try_element_at(m, F.lit(ZERO_FIELD))
        return (F.when(m.isNull(), F.lit(False)).when(v.isNull() | ~v.rlike(r"\S"), F.lit(True))
                .otherwise(v.rlike(ZERO_TEXT) & v.rlike(HAS_ZERO_DIGIT)))

    # A lambda variable: every branch reads the message that was parsed once.
    return (F.when(~F.coalesce(p.rlike(r"\S"), F.lit(False)), F.lit(True))
            .otherwise(F.get(F.transform(F.array(parse_message(payload)), zero), F.lit(0))))


def zero_filter(phased: DataFrame) -> DataFrame:
    """M5: initial payloads without a real position; intraday keeps zeros."""
    return phased.where((F.col("phase") != "initial") | ~zero_position_excluded())


def initial_batch(phased: DataFrame) -> DataFrame:
    """M4 + M5: initial payloads released by a heartbeat, zero filter applied.

    A session that never sees a heartbeat releases nothing."""
    return zero_filter(phased.where((F.col("phase") == "initial") & F.col("released")))


def session_metrics(phased: DataFrame, key=SESSION_KEY) -> DataFrame:
    """M6: counters and last message time per session."""
    kept_initial = (F.col("phase") == "initial") & ~zero_position_excluded()
    return (phased.groupBy(*key).agg(
        F.count_if(kept_initial).cast("bigint").alias("initial_objects"),
        F.count_if(F.col("phase") == "intraday").cast("bigint").alias("intraday_objects"),
        F.count_if(F.col("phase") == "heartbeat").cast("bigint").alias("heartbeats"),
        F.max("received_at").alias("last_message_at"),
        F.when(F.bool_or("released"), "Intraday").otherwise("InitialPaint").alias("state")))


def request_id(header_id: Column | str | None, key_cols=("load_bb_entity_type",
                                                          "load_bb_entity_name",
                                                          "as_of_date")) -> Column:
    """M7: the server's request id, else a deterministic id from the session
    key (so a retried job agrees with itself)."""
    fallback = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols]), 256)
    if header_id is None:
        return fallback
    h = F.col(header_id) if isinstance(header_id, str) else header_id
    return F.when(F.trim(h) != "", h).otherwise(fallback)


def effective_as_of(value: str | None) -> Column:
    """M8: given date, blank → today."""
    if value is None or not str(value).strip():
        return F.current_date()
    return F.to_date(F.lit(str(value).strip()), "yyyy-MM-dd")
