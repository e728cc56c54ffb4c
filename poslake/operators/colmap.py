"""Column map: the metadata that drives the raw → typed projection.

One map row per target column (source column, kind, transform and update
expressions, flags).  The map is small, so it is read on the driver and
turned into expression strings for ``selectExpr`` (S6, N4–N7, N15–N17).
Expressions are plain SQL with the tokens ``source_column`` / ``target_column``
standing for the row's own column; the same text runs in Spark and DuckDB.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import COLMAP_SCHEMA, POSITIONS_COLUMNS, SOURCE_KINDS

#: A map row with this target ranks the rows of a security; its windows see all scopes of a run, so they name the scope.
RANK_COLUMN = "row_number"


class ColumnMapError(ValueError):
    """Raised for an empty or inconsistent column map."""


# ---------------------------------------------------------------------------
# Default map authored by this repo (the reference ships none).  Fixed values:
# the yellow keys recognised at the end of a security description and the
# asset class each belongs to.
YELLOW_KEYS = ("Govt", "Corp", "Mtge", "M-Mkt", "Muni", "Pfd", "Equity", "Comdty", "Index",
               "Curncy")
ASSET_CLASS_OF = {
    "Equity": ("Equity", "Pfd", "Index"),
    "Fixed Income": ("Govt", "Corp", "Mtge", "Muni", "M-Mkt"),
    "FX": ("Curncy",),
    "Commodity": ("Comdty",),
}


def _in_list(values) -> str:
    return "(" + ", ".join("'" + v + "'" for v in values) + ")"


_LAST_WORD = "split_part(source_column, ' ', -1)"
_FX_COND = "source_column LIKE '% Curncy' AND base_crncy IS NOT NULL"
_NUM = "TRY_CAST(replace(trim(source_column), ',', '') AS DECIMAL(30,9))"
_DEC = "CAST(source_column AS DECIMAL(30,9))"
_INITIAL_ONLY = "CASE WHEN is_intraday = 'false' THEN {} END"
_TAKE_NEW = "target_column = EXCLUDED.target_column"


def _asset_class_expr() -> str:
    whens = " ".join(f"WHEN {_LAST_WORD} IN {_in_list(keys)} THEN '{cls}'"
                     for cls, keys in ASSET_CLASS_OF.items())
    return f"CASE {whens} END"


# (map_id, source_column, target_column, source_kind, is_active, is_required,
#  transform_expr, update_set_expr, data_type)
DEFAULT_MAP_ROWS = [
    (1, "account", "account_id", "json", True, True, "trim(source_column)", None, "string"),
    (2, "as_of_date", "as_of_date", "loader", True, True, None, None, "date"),
    (3, "id_bb_unique", "id_bb_unique", "json", True, True, None, None, "string"),
    (4, "id_cusip", "cusip", "json", True, True, None, None, "string"),
    (5, "id_bb_global", "figi", "json", True, True,
     "coalesce(source_column, 'NOFIGI_ROW_ID_' || CAST(load_order AS STRING))", None, "string"),
    (6, "crncy", "currency", "json", True, True, "upper(source_column)", _TAKE_NEW, "string"),
    (7, "deal_ticket_num", "deal_ticket_num", "json", True, True,
     "CAST(NULLIF(trim(source_column), '0') AS BIGINT)", None, "bigint"),
    (8, "load_bb_entity_name", "load_bb_entity_name", "loader", True, True, None, None, "string"),
    (9, "load_bb_entity_type", "load_bb_entity_type", "loader", True, True, None, None, "string"),
    (10, "msg_request_id", "msg_request_id", "loader", True, True, None, None, "string"),
    (11, "load_process", "load_process", "loader", True, True, None, None, "string"),
    (12, "load_order", "load_order", "internal", True, True, None, None, "bigint"),
    (13, "load_order", "inbound_row_id", "internal", True, True,
     "CAST(source_column AS BIGINT)", None, "bigint"),
    (14, "security", "bb_security_identifier_desc", "json", True, True, None, _TAKE_NEW, "string"),
    (15, "local_market_value", "market_value_current", "json", True, True, _DEC, _TAKE_NEW,
     "decimal(30,9)"),
    (16, "local_market_value", "market_value_raw", "json", True, True, _DEC, _TAKE_NEW,
     "decimal(30,9)"),
    (17, "local_market_value", "market_value_initial_paint", "json", True, True,
     _INITIAL_ONLY.format(_DEC), None, "decimal(30,9)"),
    (18, "position_without_pending", "quantity_current", "json", True, True, _NUM, _TAKE_NEW,
     "decimal(30,9)"),
    (19, "position_without_pending", "quantity_current_initial_paint", "json", True, True,
     _INITIAL_ONLY.format(_NUM), None, "decimal(30,9)"),
    (20, "position_plus_pending", "quantity_proposed", "json", True, True, _NUM, _TAKE_NEW,
     "decimal(30,9)"),
    (21, "position_plus_pending", "quantity_proposed_initial_paint", "json", True, True,
     _INITIAL_ONLY.format(_NUM), None, "decimal(30,9)"),
    (22, "net_exposure", "exposure_amount", "json", True, True, _DEC, _TAKE_NEW, "decimal(30,9)"),
    (23, "id_isin", "isin", "json", True, True, None, None, "string"),
    (24, "shortflag", "short_flag", "json", True, True, "coalesce(source_column = 'Y', false)",
     _TAKE_NEW, "boolean"),
    (25, "security", "fx_flag", "computed", True, True, _FX_COND, None, "boolean"),
    (26, "fut_month_yr", "fut_flag", "json", True, True,
     "coalesce(trim(source_column), '') <> ''", _TAKE_NEW, "boolean"),
    (27, "sw_market_val", "swap_flag", "json", True, True,
     "coalesce(trim(source_column), '') <> ''", _TAKE_NEW, "boolean"),
    (28, "security", "enforce_uniqueness", "computed", True, True, f"NOT ({_FX_COND})", None,
     "boolean"),
    (29, "security", "loader_derived_yellow_key", "computed", True, True,
     f"CASE WHEN {_LAST_WORD} IN {_in_list(YELLOW_KEYS)} THEN {_LAST_WORD} END", None, "string"),
    (30, "security", "loader_derived_asset_class", "computed", True, True, _asset_class_expr(),
     None, "string"),
    (31, "security", "loader_derived_instrument_type", "computed", True, True,
     "CASE WHEN coalesce(trim(fut_month_yr), '') <> '' THEN 'Future' "
     "WHEN coalesce(trim(sw_market_val), '') <> '' THEN 'Swap' "
     f"WHEN {_FX_COND} THEN 'Forward' ELSE 'Cash' END", None, "string"),
    (32, "is_intraday", "load_bb_action", "loader", True, True,
     "CASE WHEN source_column = 'false' THEN 'initial' END", None, "string"),
    (33, "is_intraday", "load_status", "loader", True, True,
     "CASE WHEN source_column = 'true' THEN 'UPDATE' ELSE 'NEW' END", _TAKE_NEW, "string"),
    (34, "ivol", "ivol", "json", False, False, None, None, "string"),
    # Loaded (the flags read it) but not projected on its own.
    (35, "base_crncy", "base_crncy", "json", False, False, None, None, "string"),
]


def default_map_df(spark: SparkSession) -> DataFrame:
    rows = [(mid, "positions", src, tgt, dtype, None, act, req, None, tr, up, kind)
            for (mid, src, tgt, kind, act, req, tr, up, dtype) in DEFAULT_MAP_ROWS]
    return spark.createDataFrame(rows, COLMAP_SCHEMA)


# ---------------------------------------------------------------------------
@dataclass(frozen=True)
class MapRow:
    map_id: int
    source_column: str | None
    target_column: str
    source_kind: str
    is_active: bool
    is_required: bool
    transform_expr: str | None = None
    update_set_expr: str | None = None
    data_type: str | None = None
    domain: str = "positions"
    comments: str | None = None


@dataclass
class ColumnMap:
    """Driver-side view of the map (tens of rows)."""

    rows: list[MapRow] = field(default_factory=list)

    @classmethod
    def from_df(cls, df: DataFrame) -> "ColumnMap":
        cols = set(df.columns)
        keep = [c for c in ("map_id", "source_column", "target_column", "source_kind",
                            "is_active", "is_required", "transform_expr", "update_set_expr",
                            "data_type", "domain", "comments") if c in cols]
        rows = [MapRow(**r.asDict()) for r in df.select(*keep).collect()]
        return cls(rows)

    @classmethod
    def default(cls) -> "ColumnMap":
        return cls([MapRow(mid, src, tgt, kind, act, req, tr, up, dt)
                    for (mid, src, tgt, kind, act, req, tr, up, dt) in DEFAULT_MAP_ROWS])

    # N4 -------------------------------------------------------------------
    def select_list(self, quote=None) -> list[str]:
        """``expr AS target`` for active rows of kind ≠ computed_upd, by target."""
        q = quote or quote_spark
        out = []
        for m in sorted(self._active(exclude_kind="computed_upd"), key=lambda r: r.target_column):
            expr = (substitute(m.transform_expr, "source_column", q(m.source_column))
                    if m.transform_expr else q(m.source_column))
            out.append(f"{expr} AS {q(m.target_column)}")
        self._check_nonempty(out)
        return out

    # N5 -------------------------------------------------------------------
    def target_list(self) -> list[str]:
        out = sorted(m.target_column for m in self.rows if m.is_active and m.is_required)
        self._check_nonempty(out)
        return out

    def insert_list(self, produced=(), columns=POSITIONS_COLUMNS) -> list[str]:
        """The columns of the positions table that a new row gets from the map, in table order; all others are NULL.

        ``produced`` are columns made by an operator (the weights): they are inserted unless a row of the
        map names them, which then decides.  A listed target that nothing makes, or that is no column, is an error."""
        named = {m.target_column for m in self.rows}
        made = {m.target_column for m in self._active(exclude_kind="computed_upd")} | set(produced)
        listed = set(self.target_list())
        for c in sorted(listed):
            if c not in made:
                raise ColumnMapError(f"target {c!r} is required but no active row makes it")
            if c not in columns:
                raise ColumnMapError(f"target {c!r} is required but is no column of the table")
        return [c for c in columns if c in listed or (c in produced and c not in named)]

    # N6 -------------------------------------------------------------------
    def update_list(self) -> dict[str, str]:
        """target → right-hand side of its SET clause (token replaced)."""
        out = {}
        for m in sorted(self.rows, key=lambda r: r.target_column):
            if m.is_active and m.is_required and m.update_set_expr:
                lhs, rhs = _split_set(substitute(m.update_set_expr, "target_column",
                                                 m.target_column))
                out[lhs] = rhs
        return out

    def computed_upd(self) -> list[MapRow]:
        return sorted(self._active(only_kind="computed_upd"), key=lambda r: r.target_column)

    # S6 -------------------------------------------------------------------
    def load_columns(self) -> list[tuple[str, str]]:
        seen: dict[str, str] = {}
        out = []
        for m in self.rows:
            src, kind = m.source_column, m.source_kind
            if not src or not src.strip() or kind not in ("json", "loader"):
                continue
            if src in seen and seen[src] != kind:
                raise ColumnMapError(f"column {src!r} is listed as both {seen[src]} and {kind}")
            if src not in seen:
                seen[src] = kind
                out.append((src, kind))
        return out

    def _active(self, exclude_kind=None, only_kind=None):
        for m in self.rows:
            if not m.is_active:
                continue
            if exclude_kind and m.source_kind == exclude_kind:
                continue
            if only_kind and m.source_kind != only_kind:
                continue
            yield m

    @staticmethod
    def _check_nonempty(lst):
        if not lst:
            raise ColumnMapError("no active mappings in the column map")  # N7


def quote_spark(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def quote_sql(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def substitute(expr: str, token: str, replacement: str) -> str:
    """Replace a whole-word token (the map's ``source_column`` placeholder)."""
    return re.sub(rf"\b{token}\b", lambda _m: replacement, expr)


def _split_set(clause: str) -> tuple[str, str]:
    lhs, _, rhs = clause.partition("=")
    return lhs.strip().strip('"`'), rhs.strip()


# ---------------------------------------------------------------------------
# DataFrame operators over the map itself.

def map_projection(inbound: DataFrame, cmap: ColumnMap, keep=()) -> DataFrame:
    """Metadata-driven projection of raw inbound rows (``keep``: raw
    columns carried along unchanged)."""
    return inbound.selectExpr(*[quote_spark(c) for c in keep], *cmap.select_list())


def load_columns_df(colmap: DataFrame) -> DataFrame:
    """S6 as a DataFrame: distinct (source_column, source_kind) to load."""
    return (colmap.where(F.col("source_kind").isin("json", "loader")
                         & F.col("source_column").isNotNull()
                         & (F.trim("source_column") != ""))
            .select("source_column", "source_kind").distinct())


def map_violations(colmap: DataFrame) -> DataFrame:
    """Rows breaking the map table's constraints, with the reason."""
    checks = [
        ("source_kind", ~F.coalesce(F.col("source_kind").isin(*SOURCE_KINDS), F.lit(False))),
        ("source_column", F.col("source_column").isNull()),
        ("target_column", F.col("target_column").isNull()),
        ("is_active", F.col("is_active").isNull()),
        ("is_required", F.col("is_required").isNull()),
    ]
    reasons = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in checks]))
    return (colmap.select("map_id", reasons.alias("reasons"))
            .where(F.size("reasons") > 0)
            .select("map_id", F.explode("reasons").alias("violation")))


SEARCH_COLUMNS = ("domain", "source_kind", "source_column", "target_column", "data_type",
                  "comments")


def map_search(colmap: DataFrame, text: str | None) -> DataFrame:
    """Case-insensitive 'contains' over the descriptive columns."""
    if text is None or not text.strip():
        return colmap
    needle = text.strip().lower()
    cond = F.lit(False)
    for c in SEARCH_COLUMNS:
        if c in colmap.columns:
            cond = cond | F.coalesce(F.lower(F.col(c)).contains(needle), F.lit(False))
    return colmap.where(cond)


def map_update(colmap: DataFrame, map_id: int, **values) -> DataFrame:
    """Replace the given fields of one row (by map_id)."""
    out = colmap
    for col, val in values.items():
        out = out.withColumn(col, F.when(F.col("map_id") == map_id, F.lit(val))
                             .otherwise(F.col(col)).cast(colmap.schema[col].dataType))
    return out


def validate_expr(spark: SparkSession, inbound_schema, source_column: str | None,
                  target_column: str | None, transform_expr: str | None,
                  update_set_expr: str | None, target_schema=None) -> dict:
    """syntax/analysis check of a map row's expressions on an empty frame
    (transforms over the inbound schema, SET clauses over the target table).

    Returns ``{"ok": True}`` or ``{"ok": False, "kind": ..., "error": ...}``
    where kind is ``transform`` or ``update_set`` and the error class tells a
    parse error from an unresolved name."""
    empty = spark.createDataFrame([], inbound_schema)
    if transform_expr and transform_expr.strip():
        expr = substitute(transform_expr, "source_column", quote_spark(source_column or ""))
        res = _try(lambda: empty.selectExpr(f"{expr} AS _probe").schema)
        if res:
            return {"ok": False, "kind": "transform", **res}
    if update_set_expr and update_set_expr.strip():
        clause = substitute(update_set_expr, "target_column", target_column or "")
        lhs, rhs = _split_set(clause)
        from ..schemas import POSITIONS_SCHEMA
        probe = spark.createDataFrame([], target_schema or POSITIONS_SCHEMA).alias("EXCLUDED")
        res = _try(lambda: probe.selectExpr(f"{rhs} AS _probe").schema) if rhs else \
            {"error_class": "PARSE", "error": "update_set_expr has no right-hand side"}
        if res:
            return {"ok": False, "kind": "update_set", **res}
    return {"ok": True}


def _try(fn):
    try:
        fn()
        return None
    except ParseException as e:
        return {"error_class": "PARSE", "error": str(e).splitlines()[0]}
    except AnalysisException as e:
        return {"error_class": "ANALYSIS", "error": str(e).splitlines()[0]}
