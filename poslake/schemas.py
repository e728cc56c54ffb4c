"""Table schemas and key lists (the data model of the positions system)."""

from __future__ import annotations

from pyspark.sql import types as T

D30 = T.DecimalType(30, 9)

# positions table: 46 columns.  Decimal amounts are (30,9); flags boolean.
POSITIONS_FIELDS: list[tuple[str, T.DataType]] = [
    ("account_id", T.StringType()),
    ("as_of_date", T.DateType()),
    ("id_bb_unique", T.StringType()),
    ("cusip", T.StringType()),
    ("figi", T.StringType()),
    ("currency", T.StringType()),
    ("deal_ticket_num", T.LongType()),
    ("load_bb_entity_name", T.StringType()),
    ("market_value_current", D30),
    ("market_value_current_pct", D30),
    ("market_value_initial_paint", D30),
    ("market_value_initial_paint_pct", D30),
    ("market_value_raw", D30),
    ("quantity_current", D30),
    ("quantity_current_initial_paint", D30),
    ("quantity_proposed", D30),
    ("quantity_proposed_initial_paint", D30),
    ("exposure_amount", D30),
    ("exposure_pct", D30),
    ("nav_poller_calculated", D30),
    ("bb_security_identifier_desc", T.StringType()),
    ("create_user", T.StringType()),
    ("enforce_uniqueness", T.BooleanType()),
    ("fut_flag", T.BooleanType()),
    ("fx_flag", T.BooleanType()),
    ("fx_rate", D30),
    ("inbound_row_id", T.LongType()),
    ("isin", T.StringType()),
    ("issue_country", T.StringType()),
    ("last_update", T.TimestampNTZType()),
    ("last_update_by", T.StringType()),
    ("load_bb_action", T.StringType()),
    ("load_bb_entity_type", T.StringType()),
    ("load_bb_uuid", T.IntegerType()),
    ("load_date", T.TimestampNTZType()),
    ("load_order", T.LongType()),  # the message's own order: beyond 2^31 at scale
    ("load_process", T.StringType()),
    ("load_status", T.StringType()),
    ("loader_derived_asset_class", T.StringType()),
    ("loader_derived_instrument_type", T.StringType()),
    ("loader_derived_yellow_key", T.StringType()),
    ("msg_request_id", T.StringType()),
    ("sedol", T.StringType()),
    ("short_flag", T.BooleanType()),
    ("swap_flag", T.BooleanType()),
    ("ticker", T.StringType()),
]
POSITIONS_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in POSITIONS_FIELDS])
POSITIONS_COLUMNS = [n for n, _ in POSITIONS_FIELDS]
POSITIONS_TYPES = dict(POSITIONS_FIELDS)

# SQL type names for the same columns (used to cast NULL placeholders; the
# names are valid in Spark SQL and in DuckDB).
SQL_TYPE = {
    T.StringType(): "STRING",
    T.DateType(): "DATE",
    T.LongType(): "BIGINT",
    T.IntegerType(): "INT",
    T.BooleanType(): "BOOLEAN",
    D30: "DECIMAL(30,9)",
    T.TimestampNTZType(): "TIMESTAMP",
}


def sql_type(col: str) -> str:
    return SQL_TYPE[POSITIONS_TYPES[col]]


# Keys that define the upsert semantics.
PRIMARY_KEY = ["account_id", "as_of_date", "load_bb_entity_type", "msg_request_id", "load_order"]
# Partial unique key (rows with enforce_uniqueness IS TRUE only); figi and
# cusip enter through COALESCE(x, '').
NONFX_KEY = ["account_id", "as_of_date", "figi", "cusip", "load_bb_entity_type", "msg_request_id"]
NONFX_COALESCED = ("figi", "cusip")
# FX unique key, all rows; a NULL part never conflicts.
FX_KEY = ["account_id", "as_of_date", "deal_ticket_num", "currency", "load_bb_entity_type",
          "msg_request_id"]
# One call of the upsert procedure covers one (date, entity, load process);
# batch jobs run every scope at once, so each operator is keyed by it.
SCOPE = ["as_of_date", "load_bb_entity_name", "load_process"]
# Best-row partition (one row kept per group, highest load_order).
BEST_ROW_KEY = ["load_bb_entity_name", "load_process", "account_id", "as_of_date",
                "id_bb_unique", "cusip"]
# Netting rollup group.
ROLLUP_KEY = ["load_bb_entity_name", "load_process", "account_id", "id_bb_unique", "as_of_date"]
# Portfolio (weights denominator).
PORTFOLIO_KEY = ["load_bb_entity_name", "load_process", "account_id", "as_of_date"]

# Stream archive.
ARCHIVE_SCHEMA = T.StructType([
    T.StructField("as_of_date", T.DateType()),
    T.StructField("load_bb_entity_type", T.StringType()),
    T.StructField("load_bb_entity_name", T.StringType()),
    T.StructField("msg_request_id", T.StringType()),
    T.StructField("stream_order", T.LongType()),
    T.StructField("received_at", T.TimestampType()),
    T.StructField("load_bb_action", T.StringType()),
    T.StructField("json_stream", T.StringType()),
])
SESSION_KEY = ["as_of_date", "load_bb_entity_type", "load_bb_entity_name", "msg_request_id"]

# Column map (metadata that drives the projection).
COLMAP_SCHEMA = T.StructType([
    T.StructField("map_id", T.LongType()),
    T.StructField("domain", T.StringType()),
    T.StructField("source_column", T.StringType()),
    T.StructField("target_column", T.StringType()),
    T.StructField("data_type", T.StringType()),
    T.StructField("comments", T.StringType()),
    T.StructField("is_active", T.BooleanType()),
    T.StructField("is_required", T.BooleanType()),
    T.StructField("default_expr", T.StringType()),
    T.StructField("transform_expr", T.StringType()),
    T.StructField("update_set_expr", T.StringType()),
    T.StructField("source_kind", T.StringType()),
])
SOURCE_KINDS = ("json", "loader", "default", "computed", "computed_upd", "internal")

# Run log (job + detail).
RUNLOG_SCHEMA = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("date_job_start", T.TimestampNTZType()),
    T.StructField("date_job_end", T.TimestampNTZType()),
    T.StructField("job_status_code", T.IntegerType()),
    T.StructField("job_status_description", T.StringType()),
])
RUNLOG_DETAIL_SCHEMA = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("procedure_name", T.StringType()),
    T.StructField("parameter_list", T.StringType()),
    T.StructField("status_text", T.StringType()),
    T.StructField("date_status", T.TimestampNTZType()),
])
