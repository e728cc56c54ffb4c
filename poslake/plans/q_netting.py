"""Queries for normalise + netting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import netting
from ..operators.colmap import RANK_COLUMN, ColumnMap, MapRow
from ..operators.normalise import WEIGHT_COLUMNS, best_rows, conform_positions, portfolio_nav, strict_inbound
from ..schemas import BEST_ROW_KEY
from ..session import cut, store
from .catalog import load, register, with_fixtures
from .sqltext import (best_cte, conform, fx_select, netting_ctes, nonfx_best_select,
                      rollup_select, si_columns, staged_ctes, strict_inbound_ctes)


def initial_scan(spark, sf_dir):
    return load(spark, sf_dir, "fx_inbound").where((F.col("is_processed") == "false") & (F.col("is_intraday") == "false"))


def initial_si(spark, sf_dir):
    """strict_inbound over every unprocessed initial row (all scopes)."""
    return strict_inbound(initial_scan(spark, sf_dir))


def initial_stored(spark, sf_dir):
    """The same rows for the netting branches, which read them several times: the typed rows written once, and the
    NAV of their portfolios, from which the rows that a branch keeps get their weights."""
    si = store(strict_inbound(initial_scan(spark, sf_dir), weights=False))
    return si, cut(portfolio_nav(si))


_PRE = with_fixtures("fx_inbound") + ", " + strict_inbound_ctes()


@register("short_groups", _PRE + ",\n" + netting_ctes() + "\nSELECT * FROM psi")
def q_short_groups(spark, sf_dir):
    return netting.short_groups(initial_stored(spark, sf_dir)[0])


@register("fx_rows", _PRE + "\n" + fx_select())
def q_fx_rows(spark, sf_dir):
    return conform_positions(netting.fx_rows(initial_si(spark, sf_dir)))


@register("nonfx_best", _PRE + ",\n" + netting_ctes() + ",\n" + best_cte() + "\n"
          + nonfx_best_select())
def q_nonfx_best(spark, sf_dir):
    si, nav = initial_stored(spark, sf_dir)
    return conform_positions(netting.nonfx_best(si, nav=nav))


@register("short_rollup", _PRE + ",\n" + netting_ctes() + "\n" + rollup_select())
def q_short_rollup(spark, sf_dir):
    si, nav = initial_stored(spark, sf_dir)
    return conform_positions(netting.short_rollup(si, cut(netting.short_groups(si)), nav=nav))


@register("nonfx_staged", _PRE + ",\n" + staged_ctes() + "\nSELECT * FROM staged")
def q_nonfx_staged(spark, sf_dir):
    si, nav = initial_stored(spark, sf_dir)
    return netting.nonfx_staged(si, nav=nav)


_BEST_KEYS = ", ".join(BEST_ROW_KEY)


@register("best_row", _PRE + ",\n" + best_cte() + f"\nSELECT {_BEST_KEYS}, load_order FROM best")
def q_best_row(spark, sf_dir):
    si, nav = initial_stored(spark, sf_dir)
    return best_rows(si, nav=nav).select(*BEST_ROW_KEY, "load_order")


_W = ("account_id", "as_of_date", "load_bb_entity_name", "load_process", "load_order",
      "nav_poller_calculated", "market_value_current_pct", "market_value_initial_paint_pct",
      "exposure_pct")


@register("weights", _PRE + f"\nSELECT {', '.join(_W)} FROM si")
def q_weights(spark, sf_dir):
    return initial_si(spark, sf_dir).select(*_W)


@register("strict_inbound", _PRE + f"\nSELECT {conform('', si_columns())} FROM si")
def q_strict_inbound(spark, sf_dir):
    return conform_positions(initial_si(spark, sf_dir))


_OWN_RANK = "row_number() OVER (PARTITION BY as_of_date, load_bb_entity_name, load_process, trim(account), id_bb_unique ORDER BY load_order)"
_INSERTED = ("account_id", "as_of_date", "load_bb_entity_name", "load_process", "id_bb_unique", "load_order", "currency", "cusip",
             "figi", "isin", "market_value_current", "nav_poller_calculated")


def own_map() -> ColumnMap:
    """The default map but: no ISIN, FIGI only as a helper, and a rank of its own (the first row of a security)."""
    off = {"isin": {"is_active": False}, "figi": {"is_required": False}}
    rows = [MapRow(**(vars(m) | off.get(m.target_column, {}))) for m in ColumnMap.default().rows]
    return ColumnMap([*rows, MapRow(900, "load_order", RANK_COLUMN, "computed", True, False, _OWN_RANK)])


@register("map_inserts", _PRE + ",\n" + netting_ctes() + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY as_of_date, load_bb_entity_name, load_process, account_id, id_bb_unique
                                        ORDER BY load_order) AS own_rank FROM si)
SELECT account_id, as_of_date, load_bb_entity_name, load_process, id_bb_unique, CAST(load_order AS BIGINT) AS load_order, currency, cusip,
  CAST(NULL AS STRING) AS figi, CAST(NULL AS STRING) AS isin, market_value_current, nav_poller_calculated
FROM ranked b WHERE own_rank = 1 AND fx_flag = false AND NOT EXISTS (
  SELECT 1 FROM psi p WHERE p.as_of_date = b.as_of_date AND p.load_bb_entity_name = b.load_bb_entity_name
    AND p.load_process = b.load_process AND (b.id_bb_unique IS NULL OR p.id_bb_unique = b.id_bb_unique))""")
def q_map_inserts(spark, sf_dir):
    """N5, U3 from a map: its insert list and its own rank."""
    from .upsert_job import inserted
    cmap = own_map()
    si = store(strict_inbound(initial_scan(spark, sf_dir), cmap, weights=False))
    best = netting.nonfx_best(si, cut(netting.short_groups(si)), cut(portfolio_nav(si)))
    return inserted(best, cmap.insert_list(WEIGHT_COLUMNS)).select(*_INSERTED)
