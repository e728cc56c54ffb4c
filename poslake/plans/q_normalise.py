"""Queries for the scalar / projection operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify
from ..functions.fields import figi_fallback, ticket_clean
from ..functions.numeric import is_numeric
from ..operators.colmap import ColumnMap, map_projection
from ..operators.normalise import unprocessed
from .catalog import load, register, with_fixtures

_IN = with_fixtures("fx_inbound")
_K = "account, load_order"


def _inbound(spark, sf_dir):
    return load(spark, sf_dir, "fx_inbound")


@register("unprocessed", _IN + """SELECT * FROM fx_inbound WHERE is_processed = 'false'
  AND as_of_date = DATE '2024-01-02' AND load_bb_entity_name = 'GRP1'
  AND load_process = 'batch-loader'""")
def q_unprocessed(spark, sf_dir):
    return unprocessed(_inbound(spark, sf_dir), "2024-01-02", "GRP1", "batch-loader")


@register("ticket_clean", _IN + f"""SELECT {_K}, deal_ticket_num AS deal_ticket_raw,
  CAST(NULLIF(trim(deal_ticket_num), '0') AS BIGINT) AS deal_ticket_num FROM fx_inbound""")
def q_ticket_clean(spark, sf_dir):
    return _inbound(spark, sf_dir).select(
        "account", "load_order", F.col("deal_ticket_num").alias("deal_ticket_raw"),
        ticket_clean("deal_ticket_num").alias("deal_ticket_num"))


@register("figi_fallback", _IN + f"""SELECT {_K},
  COALESCE(id_bb_global, 'NOFIGI_ROW_ID_' || CAST(load_order AS STRING)) AS figi FROM fx_inbound""")
def q_figi_fallback(spark, sf_dir):
    return _inbound(spark, sf_dir).select(
        "account", "load_order", figi_fallback("id_bb_global", "load_order").alias("figi"))


# The oracle restates the design rules directly (not via the map text).
_FX = "(security LIKE '% Curncy' AND base_crncy IS NOT NULL)"


@register("derived_flags", _IN + f"""SELECT {_K}, {_FX} AS fx_flag,
  COALESCE(trim(fut_month_yr), '') <> '' AS fut_flag,
  COALESCE(trim(sw_market_val), '') <> '' AS swap_flag,
  COALESCE(shortflag = 'Y', false) AS short_flag,
  NOT {_FX} AS enforce_uniqueness FROM fx_inbound""")
def q_derived_flags(spark, sf_dir):
    return _inbound(spark, sf_dir).select(
        "account", "load_order", classify.fx_flag().alias("fx_flag"),
        classify.fut_flag().alias("fut_flag"), classify.swap_flag().alias("swap_flag"),
        classify.short_flag().alias("short_flag"),
        classify.enforce_uniqueness().alias("enforce_uniqueness"))


_YK = "split_part(security, ' ', -1)"


@register("classify", _IN + f"""SELECT {_K},
  CASE WHEN {_YK} IN ('Govt', 'Corp', 'Mtge', 'M-Mkt', 'Muni', 'Pfd', 'Equity', 'Comdty', 'Index',
                      'Curncy') THEN {_YK} END AS loader_derived_yellow_key,
  CASE WHEN {_YK} IN ('Equity', 'Pfd', 'Index') THEN 'Equity'
       WHEN {_YK} IN ('Govt', 'Corp', 'Mtge', 'Muni', 'M-Mkt') THEN 'Fixed Income'
       WHEN {_YK} = 'Curncy' THEN 'FX' WHEN {_YK} = 'Comdty' THEN 'Commodity'
  END AS loader_derived_asset_class,
  CASE WHEN COALESCE(trim(fut_month_yr), '') <> '' THEN 'Future'
       WHEN COALESCE(trim(sw_market_val), '') <> '' THEN 'Swap'
       WHEN {_FX} THEN 'Forward' ELSE 'Cash' END AS loader_derived_instrument_type
FROM fx_inbound""")
def q_classify(spark, sf_dir):
    return _inbound(spark, sf_dir).select(
        "account", "load_order", classify.yellow_key().alias("loader_derived_yellow_key"),
        classify.asset_class().alias("loader_derived_asset_class"),
        classify.instrument_type().alias("loader_derived_instrument_type"))


def _is_numeric_sql(v: str, precision: int, scale: int) -> str:
    c = f"replace({v}, ',', '')"
    ip = f"ltrim(split_part(ltrim(ltrim({c}, '-'), '+'), '.', 1), '0')"
    return (f"CASE WHEN {v} IS NULL THEN NULL "
            f"WHEN NOT regexp_full_match({c}, '[-+]?[0-9]*\\.?[0-9]+') THEN false "
            f"WHEN length({ip}) > {precision - scale} THEN false "
            f"ELSE abs(round(CAST({c} AS DECIMAL(38,{38 - max(precision - scale, 1)})), {scale}))"
            f" < {10 ** (precision - scale)} END")


@register("is_numeric", _IN + f"""SELECT {_K}, position_without_pending, position_plus_pending,
  {_is_numeric_sql('position_without_pending', 5, 2)} AS pwp_numeric,
  {_is_numeric_sql('position_plus_pending', 5, 2)} AS ppp_numeric,
  {_is_numeric_sql('local_market_value', 12, 2)} AS lmv_numeric
FROM fx_inbound""")
def q_is_numeric(spark, sf_dir):
    return _inbound(spark, sf_dir).select(
        "account", "load_order", "position_without_pending", "position_plus_pending",
        is_numeric("position_without_pending", 5, 2).alias("pwp_numeric"),
        is_numeric("position_plus_pending", 5, 2).alias("ppp_numeric"),
        is_numeric("local_market_value", 12, 2).alias("lmv_numeric"))


@register("map_projection", _IN + """SELECT account, load_order,
  trim("account") AS account_id, "as_of_date" AS as_of_date, upper("crncy") AS currency,
  CAST(NULLIF(trim("deal_ticket_num"), '0') AS BIGINT) AS deal_ticket_num,
  CAST("local_market_value" AS DECIMAL(30,9)) AS market_value_current,
  CAST(row_number() OVER (PARTITION BY account, as_of_date, id_bb_unique ORDER BY load_order DESC)
    AS INTEGER) AS row_number
FROM fx_inbound""")
def q_map_projection(spark, sf_dir):
    """N4 with the fixture's own map (rows read from the map table)."""
    colmap = load(spark, sf_dir, "fx_colmap")
    cmap = ColumnMap.from_df(colmap)
    # The row identity is kept next to the projected columns.
    return map_projection(_inbound(spark, sf_dir), cmap, keep=("account", "load_order"))
