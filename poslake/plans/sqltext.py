"""SQL text shared by the DuckDB oracle side of the catalog.

The oracle restates each operator in plain SQL the way the database would
run it (windows, correlated subqueries, NOT IN), so it checks the Spark
plans (aggregates + joins) against the straightforward formulation.
"""

from __future__ import annotations

from ..operators.colmap import ColumnMap, quote_sql
from ..operators.netting import (BOOL_AND_COLUMNS, BOOL_OR_COLUMNS, MAX_COLUMNS,
                                 MAX_ZERO_COLUMNS, SUM_COLUMNS)
from ..schemas import (BEST_ROW_KEY, PORTFOLIO_KEY, POSITIONS_COLUMNS, ROLLUP_KEY, SCOPE,
                       sql_type)

INITIAL_SCAN = "is_processed = 'false' AND is_intraday = 'false'"
INTRADAY_SCAN = "is_processed = 'false' AND is_intraday = 'true'"


def ratio_sql(num: str, den: str) -> str:
    return (f"CAST(round(CAST({num} AS DOUBLE) / CAST(NULLIF({den}, 0) AS DOUBLE), 6) "
            f"AS DECIMAL(30,9))")


def strict_inbound_ctes(where: str = INITIAL_SCAN, source: str = "fx_inbound",
                        name: str = "si", weights: bool = True) -> str:
    """CTEs ``{name}0`` (map projection) and ``{name}`` (+ weights)."""
    sel = ",\n  ".join(ColumnMap.default().select_list(quote=quote_sql))
    if not weights:
        return f"""{name}0 AS (
SELECT {sel}
FROM {source} WHERE {where}
),
{name} AS (SELECT * FROM {name}0)"""
    part = ", ".join(PORTFOLIO_KEY)
    nav = "nav_poller_calculated"
    return f"""{name}0 AS (
SELECT {sel}
FROM {source} WHERE {where}
),
{name}n AS (
SELECT *, CAST(sum(market_value_current) OVER (PARTITION BY {part}) AS DECIMAL(30,9)) AS {nav}
FROM {name}0
),
{name} AS (
SELECT *, {ratio_sql('market_value_current', nav)} AS market_value_current_pct,
  {ratio_sql('market_value_initial_paint', nav)} AS market_value_initial_paint_pct,
  {ratio_sql('exposure_amount', nav)} AS exposure_pct
FROM {name}n
)"""


def conform(alias: str = "", have: set[str] | None = None) -> str:
    """Select list onto the 46 positions columns (missing → typed NULL)."""
    p = f"{alias}." if alias else ""
    out = []
    for c in POSITIONS_COLUMNS:
        if have is None or c in have:
            out.append(f"CAST({p}{c} AS {sql_type(c)}) AS {c}")
        else:
            out.append(f"CAST(NULL AS {sql_type(c)}) AS {c}")
    return ", ".join(out)


def si_columns() -> set[str]:
    cmap = ColumnMap.default()
    cols = {m.target_column for m in cmap.rows
            if m.is_active and m.source_kind != "computed_upd"}
    return cols | {"nav_poller_calculated", "market_value_current_pct",
                   "market_value_initial_paint_pct", "exposure_pct"}


def scope_eq(a: str, b: str, cols=SCOPE) -> str:
    return " AND ".join(f"{a}.{c} = {b}.{c}" for c in cols)


def netting_ctes(si: str = "si") -> str:
    """``psi`` (U1 pairs) over ``si``."""
    return f"""psi AS (
SELECT {', '.join(SCOPE)}, account_id, id_bb_unique FROM {si} s
WHERE EXISTS (SELECT 1 FROM {si} s2 WHERE s2.short_flag = true
              AND s2.id_bb_unique = s.id_bb_unique AND {scope_eq('s2', 's')})
GROUP BY {', '.join(SCOPE)}, account_id, id_bb_unique
HAVING count(*) > 1
)"""


def best_cte(si: str = "si", name: str = "best") -> str:
    part = ", ".join(BEST_ROW_KEY)
    return f"""{name} AS (
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY load_order DESC) AS rn
               FROM {si}) r WHERE rn = 1
)"""


def nonfx_best_select(si: str = "si") -> str:
    """U3 with null-aware NOT IN semantics, correlated on the scope."""
    have = si_columns()
    return f"""SELECT {conform('b', have)} FROM best b
WHERE b.fx_flag = false
  AND CASE WHEN b.id_bb_unique IS NOT NULL
           THEN NOT EXISTS (SELECT 1 FROM psi p WHERE p.id_bb_unique = b.id_bb_unique
                            AND {scope_eq('p', 'b')})
           ELSE NOT EXISTS (SELECT 1 FROM psi p WHERE {scope_eq('p', 'b')}) END"""


def rollup_select(si: str = "si", exclude_ticketed_fx: bool = False) -> str:
    have = si_columns()

    def col(c):
        return f"si.{c}" if c in have else f"CAST(NULL AS {sql_type(c)})"

    aggs = {}
    for c in SUM_COLUMNS:
        aggs[c] = f"CAST(SUM(COALESCE({col(c)}, 0)) AS DECIMAL(30,9))"
    for c in BOOL_AND_COLUMNS:
        aggs[c] = f"BOOL_AND(COALESCE({col(c)}, FALSE))"
    for c in BOOL_OR_COLUMNS:
        aggs[c] = f"BOOL_OR(COALESCE({col(c)}, FALSE))"
    for c in MAX_ZERO_COLUMNS:
        aggs[c] = f"CAST(MAX(COALESCE({col(c)}, 0)) AS DECIMAL(30,9))"
    for c in MAX_COLUMNS:
        if c not in ROLLUP_KEY:
            aggs[c] = f"MAX({col(c)})"
    aggs["short_flag"] = "BOOL_OR(p.id_bb_unique IS NOT NULL)"
    keys = [f"si.{k}" for k in ROLLUP_KEY]
    sel = []
    for c in POSITIONS_COLUMNS:
        if c in ROLLUP_KEY:
            sel.append(f"CAST(si.{c} AS {sql_type(c)}) AS {c}")
        elif c in aggs:
            sel.append(f"CAST({aggs[c]} AS {sql_type(c)}) AS {c}")
        else:
            sel.append(f"CAST(NULL AS {sql_type(c)}) AS {c}")
    extra = ""
    if exclude_ticketed_fx:
        extra = ("AND NOT COALESCE(si.fx_flag = true AND si.deal_ticket_num IS NOT NULL "
                 "AND si.deal_ticket_num <> 0, false)")
    return f"""SELECT {', '.join(sel)}
FROM {si} si LEFT JOIN psi p ON p.account_id = si.account_id AND p.id_bb_unique = si.id_bb_unique
  AND {scope_eq('p', 'si')}
WHERE (EXISTS (SELECT 1 FROM psi q WHERE q.id_bb_unique = si.id_bb_unique AND {scope_eq('q', 'si')})
   OR (si.fx_flag = true AND (si.deal_ticket_num IS NULL OR si.deal_ticket_num = 0)))
  {extra}
GROUP BY {', '.join(keys)}"""


def fx_select(si: str = "si") -> str:
    return f"""SELECT {conform('', si_columns())} FROM {si}
WHERE fx_flag = true AND deal_ticket_num IS NOT NULL AND deal_ticket_num <> 0"""


def staged_ctes(si: str = "si", exclude_ticketed_fx: bool = False) -> str:
    """``psi``, ``best``, ``staged`` (U6) over ``si``."""
    return f"""{netting_ctes(si)},
{best_cte(si)},
staged AS (
{nonfx_best_select(si)}
UNION ALL
{rollup_select(si, exclude_ticketed_fx)}
)"""


# ---------------------------------------------------------------------------
# Upsert (U7–U11) in SQL: collapse per key, full outer merge, weights.

def _key_exprs(key_cols, coalesced, alias):
    return [f"COALESCE({alias}.{c}, '')" if c in coalesced else f"{alias}.{c}" for c in key_cols]


def eligible_sql(key_cols, coalesced, partial, alias="x"):
    conds = [f"{alias}.{c} IS NOT NULL" for c in key_cols if c not in coalesced]
    if partial:
        conds.append(f"{alias}.enforce_uniqueness = true")
    return "COALESCE(" + " AND ".join(conds) + ", false)"


def collapse_ctes(src: str, name: str, key_cols, coalesced, partial, set_cols) -> str:
    """``{name}`` = one row per key: first row by load_order, SET columns from
    the last row.  ``{name}_rest`` = rows that cannot conflict."""
    k = ", ".join(_key_exprs(key_cols, coalesced, "x"))
    cols = POSITIONS_COLUMNS
    el = eligible_sql(key_cols, coalesced, partial)
    on = " AND ".join(f"{a} = {b}" for a, b in zip(_key_exprs(key_cols, coalesced, "f"),
                                                   _key_exprs(key_cols, coalesced, "l")))
    pick = ", ".join(f"l.{c} AS {c}" if c in set_cols else f"f.{c} AS {c}" for c in cols)
    return f"""{name}_e AS (
SELECT x.*, row_number() OVER (PARTITION BY {k} ORDER BY x.load_order) AS r_first,
  row_number() OVER (PARTITION BY {k} ORDER BY x.load_order DESC) AS r_last
FROM {src} x WHERE {el}
),
{name} AS (
SELECT {pick} FROM {name}_e f JOIN {name}_e l ON {on} AND f.r_first = 1 AND l.r_last = 1
),
{name}_rest AS (
SELECT {', '.join(cols)} FROM {src} x WHERE NOT {el}
)"""


def merge_ctes(existing: str, incoming: str, name: str, key_cols, coalesced, partial,
               set_cols) -> str:
    """``{name}`` = existing merged with incoming on the key (SET columns taken
    from the incoming row on a match)."""
    coll = collapse_ctes(incoming, f"{name}_in", key_cols, coalesced, partial, set_cols)
    el = eligible_sql(key_cols, coalesced, partial)
    on = " AND ".join(f"{a} = {b}" for a, b in zip(_key_exprs(key_cols, coalesced, "e"),
                                                   _key_exprs(key_cols, coalesced, "c")))
    sel = []
    for c in POSITIONS_COLUMNS:
        if c in set_cols:
            sel.append(f"CASE WHEN e._p IS NULL THEN c.{c} WHEN c._p IS NULL THEN e.{c} "
                       f"ELSE c.{c} END AS {c}")
        else:
            sel.append(f"CASE WHEN e._p IS NULL THEN c.{c} ELSE e.{c} END AS {c}")
    cols = ", ".join(POSITIONS_COLUMNS)
    return f"""{coll},
{name}_ex AS (SELECT x.*, true AS _p FROM {existing} x WHERE {el}),
{name}_ci AS (SELECT x.*, true AS _p FROM {name}_in x),
{name}_j AS (
SELECT {', '.join(sel)},
  CASE WHEN e._p IS NULL THEN 'inserted' WHEN c._p IS NULL THEN 'kept' ELSE 'updated' END AS _action
FROM {name}_ex e FULL OUTER JOIN {name}_ci c ON {on}
),
{name} AS (
SELECT {cols} FROM {name}_j
UNION ALL SELECT {cols} FROM {existing} x WHERE NOT {el}
UNION ALL SELECT {cols} FROM {name}_in_rest
)"""


def empty_positions_cte(name: str = "empty_positions") -> str:
    return f"{name} AS (SELECT {conform('', set())} WHERE false)"


def stage_single_ctes(si: str = "sx", have: set[str] | None = None) -> str:
    """Intraday staging (every row its own batch): ``sx_staged``, ``sx_fx``."""
    from ..operators.netting import NOT_ROLLED
    have = si_columns() if have is None else have
    repl = {}
    for c in SUM_COLUMNS + MAX_ZERO_COLUMNS:
        repl[c] = f"CAST(COALESCE({c}, 0) AS DECIMAL(30,9))"
    for c in BOOL_AND_COLUMNS + BOOL_OR_COLUMNS:
        repl[c] = f"COALESCE({c}, false)"
    repl["short_flag"] = "false"
    for c in NOT_ROLLED:
        repl[c] = "CAST(NULL AS STRING)"
    conformed = conform("", have)
    one_sel = ", ".join(f"{repl[c]} AS {c}" if c in repl else c for c in POSITIONS_COLUMNS)
    return f"""{si}c AS (SELECT {conformed} FROM {si}),
{si}_staged AS (
SELECT * FROM {si}c WHERE fx_flag = false
UNION ALL
SELECT {one_sel} FROM {si}c
WHERE fx_flag = true AND (deal_ticket_num IS NULL OR deal_ticket_num = 0)
),
{si}_fx AS (
SELECT * FROM {si}c WHERE fx_flag = true AND deal_ticket_num IS NOT NULL AND deal_ticket_num <> 0
)"""


def recalc_weights_cte(table: str, touched: str, name: str) -> str:
    keys = ["account_id", "as_of_date", "load_bb_entity_name"]
    on = " AND ".join(f"t.{k} = n.{k}" for k in keys)
    part = ", ".join(keys)
    sel = []
    for c in POSITIONS_COLUMNS:
        if c == "nav_poller_calculated":
            sel.append(f"CASE WHEN n._hit THEN n._nav ELSE t.{c} END AS {c}")
        elif c == "market_value_current_pct":
            sel.append(f"CASE WHEN n._hit THEN {ratio_sql('t.market_value_current', 'n._nav')} "
                       f"ELSE t.{c} END AS {c}")
        elif c == "market_value_initial_paint_pct":
            sel.append(f"CASE WHEN n._hit THEN "
                       f"{ratio_sql('t.market_value_initial_paint', 'n._nav')} ELSE t.{c} END AS {c}")
        elif c == "exposure_pct":
            sel.append(f"CASE WHEN n._hit THEN {ratio_sql('t.exposure_amount', 'n._nav')} "
                       f"ELSE t.{c} END AS {c}")
        else:
            sel.append(f"t.{c}")
    return f"""{name}_nav AS (
SELECT {part}, CAST(sum(market_value_current) AS DECIMAL(30,9)) AS _nav, true AS _hit
FROM {table} x
WHERE EXISTS (SELECT 1 FROM {touched} u WHERE u.account_id = x.account_id
              AND u.as_of_date = x.as_of_date AND u.load_bb_entity_name = x.load_bb_entity_name)
GROUP BY {part}
),
{name} AS (
SELECT {', '.join(sel)} FROM {table} t LEFT JOIN {name}_nav n ON {on}
)"""
