"""Queries for the archive, message and session operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import messages as msg
from ..operators import sessions
from ..operators.colmap import ColumnMap
from ..schemas import SESSION_KEY
from ..sources import archive
from ..sources.inbound import LOAD_PROCESS, load_inbound
from .catalog import load, register, with_fixtures

SK = ", ".join(SESSION_KEY)
_STREAM = with_fixtures("fx_stream")
_HB = "CASE WHEN length(json_stream) <= 2 AND trim(json_stream) = '{}' THEN 1 ELSE 0 END"
# Oracle: the running count of earlier heartbeats (the database formulation).
_PHASE_CTES = _STREAM + f""", h AS (SELECT *, {_HB} AS is_hb FROM fx_stream),
p AS (SELECT *, COALESCE(sum(is_hb) OVER (PARTITION BY {SK} ORDER BY stream_order
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior_hb,
        max(is_hb) OVER (PARTITION BY {SK}) AS any_hb FROM h),
ph AS (SELECT *, CASE WHEN prior_hb = 0 AND is_hb = 1 THEN 'initial_end'
                      WHEN prior_hb = 0 THEN 'initial'
                      WHEN is_hb = 1 THEN 'heartbeat' ELSE 'intraday' END AS phase FROM p),
pv AS (SELECT *, CASE WHEN json_valid(json_stream) THEN
    json_extract_string(json_stream, '$.POSITION_WITHOUT_PENDING') END AS amount FROM ph),
zx AS (SELECT * EXCLUDE (amount), CASE
    WHEN NOT regexp_matches(COALESCE(json_stream, ''), '\\S') THEN true
    WHEN NOT json_valid(json_stream) THEN false
    WHEN amount IS NULL OR NOT regexp_matches(amount, '\\S') THEN true
    -- zero: nothing but zeros once signs, brackets, separators and exponent are gone
    ELSE regexp_full_match(regexp_replace(amount, '[eE][-+]?[0-9]+|[-+(),\\s]', '', 'g'),
                           '0+[.]?0*|[.]0+') END AS excluded
    FROM pv)"""


def _phased(spark, sf_dir):
    return msg.session_phase(load(spark, sf_dir, "fx_stream"))


@register("session_phase", _PHASE_CTES + f"\nSELECT {SK}, stream_order, phase FROM ph")
def q_session_phase(spark, sf_dir):
    return _phased(spark, sf_dir).select(*SESSION_KEY, "stream_order", "phase")


@register("zero_filter", _PHASE_CTES + f"\nSELECT {SK}, stream_order FROM zx "
          "WHERE phase = 'initial' AND NOT excluded")
def q_zero_filter(spark, sf_dir):
    p = _phased(spark, sf_dir).where(F.col("phase") == "initial")
    return msg.zero_filter(p).select(*SESSION_KEY, "stream_order")


@register("initial_batch", _PHASE_CTES + f"\nSELECT {SK}, stream_order, json_stream FROM zx "
          "WHERE phase = 'initial' AND any_hb = 1 AND NOT excluded")
def q_initial_batch(spark, sf_dir):
    return msg.initial_batch(_phased(spark, sf_dir)).select(*SESSION_KEY, "stream_order",
                                                            "json_stream")


_METRICS_SQL = f"""SELECT {SK},
  CAST(count(*) FILTER (WHERE phase = 'initial' AND NOT excluded) AS BIGINT) AS initial_objects,
  CAST(count(*) FILTER (WHERE phase = 'intraday') AS BIGINT) AS intraday_objects,
  CAST(count(*) FILTER (WHERE phase = 'heartbeat') AS BIGINT) AS heartbeats,
  max(received_at) AS last_message_at,
  CASE WHEN max(any_hb) = 1 THEN 'Intraday' ELSE 'InitialPaint' END AS state
FROM zx GROUP BY {SK}"""


@register("session_metrics", _PHASE_CTES + "\n" + _METRICS_SQL)
def q_session_metrics(spark, sf_dir):
    return msg.session_metrics(_phased(spark, sf_dir))


# ---- targets (M9–M11) ------------------------------------------------------
_TG = with_fixtures("fx_stream", "fx_targets")


@register("target_status", _PHASE_CTES + ", fx_targets AS (" + with_fixtures("fx_targets")
          .split("fx_targets AS (", 1)[1] + f""",
mt AS ({_METRICS_SQL}),
j AS (SELECT COALESCE(m.load_bb_entity_type, t.entity_type) AS entity_type,
        COALESCE(m.load_bb_entity_name, t.entity_name) AS entity_name,
        m.load_bb_entity_name IS NOT NULL AS started,
        CAST(COALESCE(m.heartbeats, 0) AS BIGINT) AS heartbeats,
        CAST(COALESCE(m.intraday_objects, 0) AS BIGINT) AS intraday_objects,
        CAST(COALESCE(m.initial_objects, 0) AS BIGINT) AS initial_objects,
        m.last_message_at
      FROM mt m FULL OUTER JOIN (SELECT DISTINCT entity_type, entity_name FROM fx_targets) t
        ON m.load_bb_entity_type = t.entity_type AND m.load_bb_entity_name = t.entity_name)
SELECT * FROM j""")
def q_target_status(spark, sf_dir):
    metrics = msg.session_metrics(_phased(spark, sf_dir))
    return sessions.target_status(metrics, load(spark, sf_dir, "fx_targets"))


@register("target_names", with_fixtures("fx_targets") + """
SELECT min(entity_name) AS entity_name FROM fx_targets WHERE lower(entity_type) = 'accounts'
GROUP BY lower(entity_name)""")
def q_target_names(spark, sf_dir):
    return sessions.target_names(load(spark, sf_dir, "fx_targets"), "accounts")


@register("sessions_for_targets", _TG + """
SELECT s.* FROM fx_stream s WHERE EXISTS (SELECT 1 FROM fx_targets t
  WHERE t.entity_type = s.load_bb_entity_type AND t.entity_name = s.load_bb_entity_name)""")
def q_sessions_for_targets(spark, sf_dir):
    return sessions.sessions_for_targets(load(spark, sf_dir, "fx_stream"),
                                         load(spark, sf_dir, "fx_targets"))


# ---- archive (S1–S4) -------------------------------------------------------
_ENT = "as_of_date, load_bb_entity_type, load_bb_entity_name"
_CURSOR_SQL = f"""SELECT {_ENT},
  CAST(COALESCE(max(CASE WHEN load_bb_action = 'initial' THEN stream_order END), 0) AS BIGINT)
    AS last_order,
  arg_max(msg_request_id, CASE WHEN load_bb_action = 'initial' THEN stream_order END)
    AS msg_request_id
FROM fx_stream GROUP BY {_ENT}"""


@register("initial_rows", _STREAM + "SELECT * FROM fx_stream WHERE load_bb_action = 'initial'")
def q_initial_rows(spark, sf_dir):
    return archive.initial_rows(load(spark, sf_dir, "fx_stream"))


@register("session_cursor", _STREAM + _CURSOR_SQL)
def q_session_cursor(spark, sf_dir):
    return archive.session_cursor(load(spark, sf_dir, "fx_stream"))


_UPDATES_SQL = f"""SELECT s.* FROM fx_stream s JOIN cur c
  ON s.as_of_date = c.as_of_date AND s.load_bb_entity_type = c.load_bb_entity_type
 AND s.load_bb_entity_name = c.load_bb_entity_name
WHERE s.stream_order > c.last_order AND s.msg_request_id = c.msg_request_id
  AND COALESCE(s.load_bb_action, '') = ''"""


@register("updates_since", _STREAM + f", cur AS ({_CURSOR_SQL})\n" + _UPDATES_SQL)
def q_updates_since(spark, sf_dir):
    a = load(spark, sf_dir, "fx_stream")
    return archive.updates_since(a, archive.session_cursor(a))


@register("session_replay", _STREAM + f", cur AS ({_CURSOR_SQL}), "
          f"ups AS ({_UPDATES_SQL} AND regexp_matches(c.msg_request_id, '\\S')),\n"
          f"snaps AS (SELECT {_ENT}, count(*) FILTER (load_bb_action = 'initial') AS n "
          f"FROM fx_stream GROUP BY {_ENT})\n"
          f"""SELECT {_ENT}, 0 AS phase, CAST(stream_order AS BIGINT) AS seq, json_stream
FROM fx_stream WHERE load_bb_action = 'initial'
UNION ALL
SELECT c.as_of_date, c.load_bb_entity_type, c.load_bb_entity_name, 1 AS phase,
  CAST(g.i AS BIGINT) AS seq, '{{}}' AS json_stream
FROM snaps c, LATERAL (SELECT unnest(range(1, CASE WHEN c.n = 0 THEN 1 ELSE 5 END
                                           + 1)) AS i) g
UNION ALL
SELECT {_ENT}, 2 AS phase, CAST(stream_order AS BIGINT) AS seq, json_stream FROM ups""")
def q_session_replay(spark, sf_dir):
    return archive.session_replay(load(spark, sf_dir, "fx_stream"))


# ---- raw inbound load (S5, N1, N2) ------------------------------------------
def _load_sql() -> str:
    cols = []
    for src, kind in ColumnMap.default().load_columns():
        if kind == "loader":
            expr = {
                "as_of_date": "as_of_date",
                "load_bb_entity_type": "load_bb_entity_type",
                "load_bb_entity_name": "load_bb_entity_name",
                "msg_request_id": "msg_request_id",
                "load_process": f"'{LOAD_PROCESS}'",
                "is_intraday": "CASE WHEN phase = 'intraday' THEN 'true' ELSE 'false' END",
            }.get(src, "CAST(NULL AS STRING)")
        else:
            expr = f"json_extract_string(json_stream, '$.{src.upper()}')"
        cols.append(f"{expr} AS {src}")
    cols += ["'false' AS is_processed", "CAST(stream_order AS BIGINT) AS load_order"]
    return (_PHASE_CTES + f""",
msgs AS (SELECT * FROM zx WHERE (phase = 'initial' AND any_hb = 1 AND NOT excluded)
                             OR phase = 'intraday')
SELECT {', '.join(cols)} FROM msgs WHERE json_valid(json_stream)""")


@register("inbound_load", _load_sql())
def q_inbound_load(spark, sf_dir):
    phased = _phased(spark, sf_dir)
    released = msg.initial_batch(phased).unionByName(phased.where(F.col("phase") == "intraday"))
    return load_inbound(released).rows


# ---- framing (M1) -------------------------------------------------------------
_FRAMED = with_fixtures("fx_stream") + """
SELECT msg_request_id, CAST(stream_order * 2 AS BIGINT) AS start_seq,
  CAST(0 AS BIGINT) AS start_offset, json_stream AS json FROM fx_stream"""


@register("reassemble", _FRAMED)
def q_reassemble(spark, sf_dir):
    from ..operators.framing import reassemble_parallel
    return reassemble_parallel(load(spark, sf_dir, "fx_chunks"))


@register("reassemble_batches", _FRAMED)
def q_reassemble_batches(spark, sf_dir):
    """All chunks in two batches: what is open at the border of a session is carried over."""
    from ..operators.framing import Carried, frame_batch
    chunks = load(spark, sf_dir, "fx_chunks")
    # chunks of a message have an even and an odd number, so every session's last message in the first batch stays open
    middle = F.floor(F.expr("percentile_approx(chunk_seq, 0.5)") / 2) * 2
    cut_at = chunks.groupBy("msg_request_id").agg(middle.alias("_cut"))
    placed = chunks.join(cut_at, "msg_request_id")
    first = frame_batch(placed.where("chunk_seq <= _cut").drop("_cut"), Carried.nothing(chunks))
    second = frame_batch(placed.where("chunk_seq > _cut").drop("_cut"), first.carried)
    return first.objects.unionByName(second.objects)
