"""Queries for the reconcile layer (C1–C9) and the positions read."""

from __future__ import annotations

from ..fixtures import FIXTURE_SQL
from ..operators import compare as cmp
from ..session import store
from .catalog import load, register, with_fixtures

KEYS = ["account_id", "as_of_date", "load_order"]
FIELDS = ["load_bb_entity_name", "load_bb_entity_type", "msg_request_id", "id_bb_unique",
          "cusip", "figi", "currency", "bb_security_identifier_desc", "short_flag",
          "market_value_current", "exposure_amount"]
NUMERIC = {"market_value_current", "exposure_amount"}
STRINGS = set(FIELDS) - NUMERIC - {"short_flag"}


def _inputs(spark, sf_dir):
    """The positions written once; the target is a projection of the stored rows, cheaper to read again than to write."""
    actual = store(load(spark, sf_dir, "fx_positions"))
    actual.createOrReplaceTempView("fx_positions")
    return spark.sql(FIXTURE_SQL["fx_target"]), actual


# ---- oracle -----------------------------------------------------------------
_PRE = with_fixtures("fx_target")
_ORDER = ", ".join(f"{c} ASC NULLS FIRST" for c in FIELDS)
_K = ", ".join(KEYS)
_ALIGN = f""",
er AS (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY {_ORDER}) AS pos FROM fx_target),
ar AS (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY {_ORDER}) AS pos FROM fx_positions),
al AS (
SELECT {', '.join(f'COALESCE(e.{k}, a.{k}) AS {k}' for k in KEYS)}, COALESCE(e.pos, a.pos) AS pos,
  CASE WHEN e.pos IS NULL THEN 'actual_only' WHEN a.pos IS NULL THEN 'expected_only'
       ELSE 'both' END AS status,
  {', '.join(f'e.{c} AS e_{c}' for c in FIELDS)}, {', '.join(f'a.{c} AS a_{c}' for c in FIELDS)}
FROM er e FULL OUTER JOIN ar a
  ON e.pos = a.pos AND {' AND '.join(f'e.{k} IS NOT DISTINCT FROM a.{k}' for k in KEYS)}
)"""


def _diff_sql(phases: dict[int, list[str]], tolerant: set[str], nocase: bool,
              tol: str = "0.00001") -> str:
    parts = []
    for phase, fields in phases.items():
        for c in fields:
            e, a = f"e_{c}", f"a_{c}"
            if c in tolerant:
                cond = (f"NOT ({e} IS NULL AND {a} IS NULL) AND (({e} IS NULL) <> ({a} IS NULL) "
                        f"OR COALESCE(abs(CAST({e} AS DECIMAL(38,18)) - CAST({a} AS DECIMAL(38,18)))"
                        f" > CAST({tol} AS DECIMAL(38,18)), false))")
            elif c in STRINGS and nocase:
                cond = f"lower({e}) IS DISTINCT FROM lower({a})"
            else:
                cond = f"{e} IS DISTINCT FROM {a}"
            parts.append(f"SELECT {phase} AS phase, {_K}, pos, '{c}' AS field, "
                         f"CAST({e} AS STRING) AS expected, CAST({a} AS STRING) AS actual "
                         f"FROM al WHERE status = 'both' AND {cond}")
        parts.append(f"SELECT {phase} AS phase, {_K}, pos, '{cmp.ROW_FIELD}' AS field, "
                     "CASE WHEN status = 'expected_only' THEN 'present' END AS expected, "
                     "CASE WHEN status = 'actual_only' THEN 'present' END AS actual "
                     "FROM al WHERE status <> 'both'")
    return "\nUNION ALL\n".join(parts)


def _opts(**kw):
    return cmp.CompareOptions(keys=KEYS, **kw)


_EXACT = _opts(tolerant_fields=set())
_TOL = _opts(use_all_fields=False, phase1_fields=NUMERIC)
_NOCASE = _opts(use_all_fields=False, phase1_fields=STRINGS, string_case_insensitive=True)
_PHASES = _opts(one_step=False, two_steps=True, use_all_fields=False,
                phase1_fields={"currency", "bb_security_identifier_desc", "short_flag"},
                phase2_fields=NUMERIC)
_DEFAULT = _opts()  # all fields, numeric tolerant, exact strings


def _phases(o):
    return cmp.field_sets(o, KEYS + FIELDS)


@register("cmp_align", _PRE + _ALIGN + f"\nSELECT {_K}, pos, status FROM al")
def q_cmp_align(spark, sf_dir):
    e, a = _inputs(spark, sf_dir)
    return cmp.align(e, a, KEYS).select(*KEYS, "pos", "status")


@register("cmp_fields", _PRE + _ALIGN + "\n" + _diff_sql(_phases(_EXACT), set(), False))
def q_cmp_fields(spark, sf_dir):
    return cmp.diff(*_inputs(spark, sf_dir), _EXACT)


@register("cmp_tolerance", _PRE + _ALIGN + "\n" + _diff_sql(_phases(_TOL), NUMERIC, False))
def q_cmp_tolerance(spark, sf_dir):
    return cmp.diff(*_inputs(spark, sf_dir), _TOL)


@register("cmp_nocase", _PRE + _ALIGN + "\n" + _diff_sql(_phases(_NOCASE), set(), True))
def q_cmp_nocase(spark, sf_dir):
    return cmp.diff(*_inputs(spark, sf_dir), _NOCASE)


@register("cmp_phases", _PRE + _ALIGN + "\n" + _diff_sql(_phases(_PHASES), NUMERIC, False))
def q_cmp_phases(spark, sf_dir):
    return cmp.diff(*_inputs(spark, sf_dir), _PHASES)


_DEFAULT_DIFF = _diff_sql(_phases(_DEFAULT), NUMERIC, False)


@register("cmp_summary", _PRE + _ALIGN + f""", d AS ({_DEFAULT_DIFF})
SELECT (SELECT count(*) FROM d WHERE phase = 1) = 0 AS success,
  (SELECT CAST(count(*) AS BIGINT) FROM fx_target) AS expected_count,
  (SELECT CAST(count(*) AS BIGINT) FROM fx_positions) AS actual_count,
  (SELECT CAST(count(*) AS BIGINT) FROM d WHERE phase = 1) AS phase1_diffs,
  CAST(NULL AS BIGINT) AS phase2_diffs""")
def q_cmp_summary(spark, sf_dir):
    e, a = _inputs(spark, sf_dir)
    return cmp.summary(e, a, cmp.diff(e, a, _DEFAULT), _DEFAULT)


@register("cmp_top", _PRE + _ALIGN + f""", d AS ({_DEFAULT_DIFF})
SELECT * FROM d ORDER BY {_K}, pos, phase, field LIMIT {cmp.MAX_FAILURE_LINES}""")
def q_cmp_top(spark, sf_dir):
    e, a = _inputs(spark, sf_dir)
    return cmp.top_failures(cmp.diff(e, a, _DEFAULT), KEYS)


@register("positions_asof", with_fixtures("fx_positions") + """
SELECT * FROM fx_positions WHERE as_of_date = DATE '2024-01-02' AND load_bb_entity_name = 'GRP1'""")
def q_positions_asof(spark, sf_dir):
    from ..sources.tables import positions_asof
    return positions_asof(load(spark, sf_dir, "fx_positions"), "2024-01-02", "GRP1")

