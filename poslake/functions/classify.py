"""Derived flags (N10) and instrument classification.

The rules live once, as SQL text in the default column map, so the map
projection, these Column helpers and the DuckDB oracle share one definition.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.colmap import DEFAULT_MAP_ROWS, quote_spark, substitute

_BY_TARGET = {r[2]: r for r in DEFAULT_MAP_ROWS}


def map_rule(target: str, source: str | None = None) -> Column:
    """The default map's transform for ``target`` as a Column."""
    row = _BY_TARGET[target]
    src = source or row[1]
    expr = row[6]
    return F.expr(substitute(expr, "source_column", quote_spark(src)) if expr else quote_spark(src))


def fx_flag(security: str = "security") -> Column:
    return map_rule("fx_flag", security)


def fut_flag(fut_month_yr: str = "fut_month_yr") -> Column:
    return map_rule("fut_flag", fut_month_yr)


def swap_flag(sw_market_val: str = "sw_market_val") -> Column:
    return map_rule("swap_flag", sw_market_val)


def short_flag(shortflag: str = "shortflag") -> Column:
    return map_rule("short_flag", shortflag)


def enforce_uniqueness(security: str = "security") -> Column:
    return map_rule("enforce_uniqueness", security)


def yellow_key(security: str = "security") -> Column:
    return map_rule("loader_derived_yellow_key", security)


def asset_class(security: str = "security") -> Column:
    return map_rule("loader_derived_asset_class", security)


def instrument_type(security: str = "security") -> Column:
    return map_rule("loader_derived_instrument_type", security)
