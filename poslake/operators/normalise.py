"""Normalise raw inbound rows into typed position rows.

N8 unprocessed scan, N4 map projection (via ColumnMap), N13 portfolio
weights, N14 best row per security.  Weights and best row are aggregates
joined back (not per-account windows): partial aggregation keeps a hot
account from landing in one task, and AQE broadcasts the small side at
runtime when its measured size allows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import BEST_ROW_KEY, PORTFOLIO_KEY, POSITIONS_COLUMNS, POSITIONS_TYPES
from .colmap import ColumnMap
from .prefilter import key_hash, may_hold, repeated

_WINDOW = re.compile(r"\bOVER\s*[(\w`]", re.IGNORECASE)
LOOKUP_ROWS = 1 << 21  # rows of 64 bytes (a hash and a value) that go to every task at most
WEIGHT_COLUMNS = ("nav_poller_calculated", "market_value_current_pct",
                  "market_value_initial_paint_pct", "exposure_pct")


def unprocessed(inbound: DataFrame, as_of_date, entity_name: str, load_process: str,
                is_intraday: bool | None = None) -> DataFrame:
    """Rows not yet processed for one date / entity / load process.

    ``is_intraday`` narrows the scan to one phase (quirk Q6 fixed); None keeps
    the original phase-blind scan."""
    cond = ((F.col("is_processed") == "false")
            & (F.col("as_of_date") == F.lit(as_of_date).cast("date"))
            & (F.col("load_bb_entity_name") == F.lit(entity_name))
            & (F.col("load_process") == F.lit(load_process)))
    if is_intraday is not None:
        cond = cond & (F.col("is_intraday") == F.lit("true" if is_intraday else "false"))
    return inbound.where(cond)


def ratio(num: Column, den: Column) -> Column:
    """num / den as DECIMAL(30,9), computed in double and rounded to 6 places
    (the same in every engine); NULL when the denominator is 0 or NULL."""
    q = num.cast("double") / F.nullif(den, F.lit(0)).cast("double")
    return F.round(q, 6).cast("decimal(30,9)")


def _null_safe_join(left: DataFrame, right: DataFrame, keys, how="left") -> DataFrame:
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def few_keys(small: DataFrame, keys) -> bool:
    """Whether ``small`` (written, one row a key) has few rows and no two of its keys share a hash."""
    n = small.count()
    return n <= LOOKUP_ROWS and small.select(key_hash(keys)).distinct().count() == n


def look_up(rows: DataFrame, small: DataFrame, keys, few: bool) -> DataFrame:
    """``rows`` with the columns of ``small``, which holds one row for every key of ``rows``.

    If they are few (``few_keys``), their key hashes and values go to every task and the wide rows are not shuffled; no two keys
    share a hash, so that is exact.  Else both sides are shuffled by the key, ``small`` as the hashed side."""
    keys = list(keys)
    if not few:
        return _null_safe_join(rows, small.hint("shuffle_hash"), keys)
    at = key_hash(keys)
    values = small.select(at.alias("_key_at"), *[c for c in small.columns if c not in keys])
    return rows.withColumn("_row_at", at).join(F.broadcast(values), F.col("_row_at") == F.col("_key_at"), "left").drop("_row_at", "_key_at")


def portfolio_nav(rows: DataFrame, keys=PORTFOLIO_KEY,
                  value: str = "market_value_current") -> DataFrame:
    """NAV per portfolio: one row per key (partial aggregation, FX included)."""
    return rows.groupBy(*keys).agg(F.sum(value).cast("decimal(30,9)").alias("_nav"))


def weights_from_nav(rows: DataFrame) -> DataFrame:
    """The weight columns of rows that carry their portfolio's NAV in ``_nav``."""
    if "market_value_initial_paint" not in rows.columns:
        rows = rows.withColumn("market_value_initial_paint", F.lit(None).cast("decimal(30,9)"))
    return (rows.withColumn("nav_poller_calculated", F.col("_nav"))
            .withColumn("market_value_current_pct", ratio(F.col("market_value_current"), F.col("_nav")))
            .withColumn("market_value_initial_paint_pct",
                        ratio(F.col("market_value_initial_paint"), F.col("_nav")))
            .withColumn("exposure_pct", ratio(F.col("exposure_amount"), F.col("_nav")))
            .drop("_nav"))


def add_weights(rows: DataFrame, keys=PORTFOLIO_KEY, nav: DataFrame | None = None) -> DataFrame:
    """NAV and market-value / exposure percentages per portfolio.

    ``nav`` (of ``portfolio_nav``, written) is given where ``rows`` are only a part of the portfolios' rows.  If not, it is
    the hashed side of a join: the wide rows are shuffled but not sorted."""
    if nav is None:
        return weights_from_nav(_null_safe_join(rows, portfolio_nav(rows, keys).hint("shuffle_hash"), list(keys)))
    return weights_from_nav(look_up(rows, nav, keys, few_keys(nav, keys)))


def strict_inbound(inbound: DataFrame, cmap: ColumnMap | None = None,
                   weights: bool = True) -> DataFrame:
    """Typed, classified rows: map projection (N4) + weights.

    Windows of the map come first, over the raw rows: these are narrower than the typed ones, and a window shuffles
    and sorts whole rows."""
    cmap = cmap or ColumnMap.default()
    exprs = cmap.select_list()
    windows = {e: f"_window_{i}" for i, e in enumerate(exprs) if _WINDOW.search(e)}
    if windows:
        parts = {e: e.rpartition(" AS ") for e in windows}
        inbound = inbound.selectExpr("*", *[f"{parts[e][0]} AS `{name}`" for e, name in windows.items()])
        exprs = [f"`{windows[e]}` AS {parts[e][2]}" if e in windows else e for e in exprs]
    out = inbound.selectExpr(*exprs)
    if weights and has_weights(out):
        out = add_weights(out)
    return out


def has_weights(rows: DataFrame) -> bool:
    """Whether the map made the columns that weights are computed from."""
    return {"market_value_current", "exposure_amount", "account_id", "as_of_date"} <= set(rows.columns)


def conform_positions(df: DataFrame) -> DataFrame:
    """Project onto the 46 positions columns; missing ones take their default (NULL)."""
    have = set(df.columns)
    kind = lambda c: POSITIONS_TYPES[c] if isinstance(POSITIONS_TYPES[c], str) else POSITIONS_TYPES[c].simpleString()
    return df.selectExpr(*[f"CAST({f'`{c}`' if c in have else 'NULL'} AS {kind(c)}) AS `{c}`" for c in POSITIONS_COLUMNS])


def best_keys(rows: DataFrame, keys=BEST_ROW_KEY, order: str = "load_order") -> DataFrame:
    """N14, narrow: each key with its highest ``order`` in ``_top``."""
    return rows.groupBy(*keys).agg(F.max(order).alias("_top"))


def best_rows(rows: DataFrame, keys=BEST_ROW_KEY, order: str = "load_order", ranked: DataFrame | None = None,
              mark: Callable[[DataFrame], DataFrame] | None = None,
              clear: Callable[[DataFrame], DataFrame] | None = None, nav: DataFrame | None = None,
              keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The row with the highest ``order`` per key (row_number() = 1).

    A row whose key no other row shares is the best of its key: a bitmap of the repeated key hashes tells most such
    rows, which pass without a shuffle.  For the others a fixed-width ``max(order)`` aggregate (partial, map-side) finds the
    winner; a null-safe join on (key, order) keeps it.  ``order`` is part of the join key, so even a key
    holding a third of all rows hashes across many partitions instead of landing in one task.

    ``ranked`` are all rows that are ranked, where ``rows`` are only those wanted.  ``clear`` takes keys out; it is asked for
    the rows that ``mark`` gives a flag ``_doubt`` by their key, all others are not affected.  With ``nav`` (of
    ``portfolio_nav``) the winners get their weights.  ``keep`` writes the winners of repeated keys, for several readers."""
    keys = list(keys)
    ranked = rows if ranked is None else ranked
    at = key_hash(keys)
    again = repeated(ranked.select(at.alias("_hash")))
    mark = mark or (lambda df: df.withColumn("_doubt", F.lit(False)))
    flagged = lambda df: mark(may_hold(df, at, again, "_again"))
    top = best_keys(flagged(ranked).where("_again OR _doubt"), keys, order)
    top = top if clear is None else clear(top)
    top = top.select(*[F.col(k).alias(f"_t_{k}") for k in keys], "_top")
    cond = F.col(order) == F.col("_top")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_t_{k}"))
    won = flagged(rows).where("_again OR _doubt").select(*rows.columns).join(top.hint("merge"), cond, "left_semi")
    alone = flagged(rows).where(f"NOT (_again OR _doubt) AND `{order}` IS NOT NULL").select(*rows.columns)
    best = alone.unionByName(won if keep is None else keep(won))
    return best if nav is None else add_weights(best, nav=nav)
