"""Test fixtures: SQL views over the driver tables (see FIXTURES.md).

Every view is the same text in Spark SQL and DuckDB, so the Spark side and
the oracle side start from identical rows.  ``register`` creates the driver
tables and these views as temp views in a Spark session; ``with_clause``
returns the views as a ``WITH`` prefix for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")

FIXTURE_SQL: dict[str, str] = {}

FIXTURE_SQL["fx_inbound"] = """\
SELECT CAST('2024-01-0' || CAST(1 + l_linenumber % 2 AS STRING) AS DATE) AS as_of_date,
  CASE WHEN l_suppkey % 2 = 0 THEN 'GRP0' ELSE 'GRP1' END AS load_bb_entity_name,
  'groups' AS load_bb_entity_type, 'batch-loader' AS load_process, 'req-1' AS msg_request_id,
  CASE WHEN l_linenumber = 7 THEN 'true' ELSE 'false' END AS is_intraday, 'false' AS is_processed,
  CAST(load_order AS INT) AS load_order,
  'ACCT' || CAST(l_suppkey AS STRING) AS account,
  CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE 'IX' || CAST(l_partkey AS STRING) END AS id_bb_unique,
  'C' || CAST(l_partkey AS STRING) AS id_cusip,
  CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE 'BBG' || CAST(l_partkey AS STRING) END AS id_bb_global,
  'US' || CAST(l_partkey AS STRING) AS id_isin,
  CASE l_partkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' ELSE 'JPY' END AS crncy,
  'USD' AS base_crncy,
  'SEC' || CAST(l_partkey AS STRING) || CASE l_partkey % 6 WHEN 0 THEN ' Equity' WHEN 1 THEN ' Corp'
    WHEN 2 THEN ' Govt' WHEN 3 THEN ' Curncy' WHEN 4 THEN ' Index' ELSE ' Comdty' END AS security,
  CASE WHEN l_returnflag = 'R' AND l_partkey % 10 = 3 THEN 'Y' ELSE 'N' END AS shortflag,
  CASE WHEN l_partkey % 6 <> 3 OR l_orderkey % 5 = 1 THEN NULL WHEN l_orderkey % 5 = 0 THEN '0'
    ELSE CAST(l_orderkey * 10 + l_linenumber AS STRING) END AS deal_ticket_num,
  CASE WHEN l_partkey % 6 = 4 THEN 'H24' ELSE NULL END AS fut_month_yr,
  CASE WHEN l_partkey % 29 = 0 THEN '12.50' ELSE NULL END AS sw_market_val,
  CASE WHEN l_partkey % 11 = 0 THEN '0' WHEN l_partkey % 13 = 0 THEN NULL WHEN l_partkey % 17 = 0 THEN 'N.A.'
    ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS position_without_pending,
  CASE WHEN l_partkey % 19 = 0 THEN '1,250.5' ELSE CAST(CAST(l_quantity AS INT) + 1 AS STRING) END AS position_plus_pending,
  CASE WHEN l_returnflag = 'R' THEN '-' ELSE '' END
    || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) AS local_market_value,
  CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) AS net_exposure
FROM (SELECT l.*, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey,
        l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS load_order
      FROM lineitem l) base
"""

FIXTURE_SQL["fx_stream"] = """\
SELECT CAST('2024-01-01' AS DATE) AS as_of_date, 'accounts' AS load_bb_entity_type,
  'U' || CAST(user_id AS STRING) AS load_bb_entity_name, 'req-' || CAST(user_id AS STRING) AS msg_request_id,
  event_id AS stream_order, ts AS received_at,
  CASE WHEN first_hb IS NULL OR event_id < first_hb THEN 'initial'
       WHEN event_id % 2 = 0 THEN '' ELSE NULL END AS load_bb_action,
  CASE WHEN is_hb = 1 THEN '{}' ELSE
    '{"ACCOUNT":"U' || CAST(user_id AS STRING) || '","ID_BB_UNIQUE":"S' || CAST(k AS STRING) || '"' ||
    CASE WHEN k % 10 = 0 THEN ',"POSITION_WITHOUT_PENDING":"0"' WHEN k % 10 = 1 THEN ''
         WHEN k % 10 = 2 THEN ',"POSITION_WITHOUT_PENDING":"N.A."'
         ELSE ',"POSITION_WITHOUT_PENDING":"' || CAST(CAST(value AS DECIMAL(18,2)) AS STRING) || '"' END ||
    ',"SECURITY":"a{b}' || chr(92) || '"c"}' END AS json_stream
FROM (SELECT user_id, event_id, ts, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
        CASE WHEN event_type = 'error' AND user_id % 7 <> 3 THEN 1 ELSE 0 END AS is_hb,
        min(CASE WHEN event_type = 'error' AND user_id % 7 <> 3 THEN event_id END) OVER (PARTITION BY user_id) AS first_hb
      FROM events) m
"""

FIXTURE_SQL["fx_chunks"] = """\
SELECT msg_request_id, stream_order * 2 AS chunk_seq,
  CASE WHEN stream_order % 10 < 3 AND length(json_stream) >= 8
       THEN substr(json_stream, 1, CAST((length(json_stream) * 7 - (length(json_stream) * 7) % 10) / 10 AS INT))
       ELSE json_stream END AS chunk
FROM fx_stream
UNION ALL
SELECT msg_request_id, stream_order * 2 + 1 AS chunk_seq,
  substr(json_stream, CAST((length(json_stream) * 7 - (length(json_stream) * 7) % 10) / 10 AS INT) + 1) AS chunk
FROM fx_stream WHERE stream_order % 10 < 3 AND length(json_stream) >= 8
"""

FIXTURE_SQL["fx_positions"] = """\
SELECT account AS account_id, as_of_date, load_order, load_bb_entity_name, load_bb_entity_type, msg_request_id,
  id_bb_unique, id_cusip AS cusip, coalesce(id_bb_global, 'NOFIGI_ROW_ID_' || CAST(load_order AS STRING)) AS figi,
  crncy AS currency, security AS bb_security_identifier_desc, shortflag = 'Y' AS short_flag,
  CAST(local_market_value AS DECIMAL(30,9)) AS market_value_current,
  CAST(net_exposure AS DECIMAL(30,9)) AS exposure_amount
FROM fx_inbound
"""

FIXTURE_SQL["fx_target"] = """\
SELECT account_id, as_of_date, load_order, load_bb_entity_name, load_bb_entity_type, msg_request_id,
  id_bb_unique, cusip, figi, CASE WHEN load_order % 31 = 0 THEN NULL ELSE currency END AS currency,
  CASE WHEN load_order % 29 = 0 THEN lower(bb_security_identifier_desc) ELSE bb_security_identifier_desc END AS bb_security_identifier_desc,
  short_flag,
  CAST(CASE WHEN load_order % 19 = 0 THEN market_value_current + CAST(0.000001 AS DECIMAL(30,9))
       WHEN load_order % 23 = 0 THEN market_value_current + CAST(1 AS DECIMAL(30,9))
       ELSE market_value_current END AS DECIMAL(30,9)) AS market_value_current,
  exposure_amount
FROM fx_positions WHERE load_order % 37 <> 0
UNION ALL
SELECT account_id || 'X' AS account_id, as_of_date, load_order, load_bb_entity_name, load_bb_entity_type, msg_request_id,
  id_bb_unique, cusip, figi, currency, bb_security_identifier_desc, short_flag, market_value_current, exposure_amount
FROM fx_positions WHERE load_order % 41 = 0
"""

FIXTURE_SQL["fx_targets"] = """\
SELECT 'accounts' AS entity_type, 'U' || CAST(user_id AS STRING) AS entity_name
FROM (SELECT DISTINCT user_id FROM events) u WHERE user_id % 5 <> 0
UNION ALL SELECT 'groups' AS entity_type, 'NOSESSION' AS entity_name
"""

FIXTURE_SQL["fx_colmap"] = """\
SELECT * FROM (VALUES
  (1, 'account', 'account_id', 'json', true, true, 'trim(source_column)', NULL),
  (2, 'as_of_date', 'as_of_date', 'loader', true, true, NULL, NULL),
  (3, 'deal_ticket_num', 'deal_ticket_num', 'json', true, true, 'CAST(NULLIF(trim(source_column), ''0'') AS BIGINT)', NULL),
  (4, 'local_market_value', 'market_value_current', 'json', true, true, 'CAST(source_column AS DECIMAL(30,9))', 'target_column = EXCLUDED.target_column'),
  (5, 'row_number', 'row_number', 'computed', true, false, 'row_number() OVER (PARTITION BY account, as_of_date, id_bb_unique ORDER BY load_order DESC)', NULL),
  (6, 'market_value_current', 'market_value_current_pct', 'computed_upd', true, false, 'market_value_current / sum(market_value_current) OVER (PARTITION BY account_id)', 'target_column = WeightData.target_column'),
  (7, 'ivol', 'ivol', 'json', false, false, NULL, NULL),
  (8, 'crncy', 'currency', 'json', true, true, 'upper(source_column)', 'target_column = EXCLUDED.target_column')
) AS t(map_id, source_column, target_column, source_kind, is_active, is_required, transform_expr, update_set_expr)
"""

FIXTURE_SQL["fx_numeric"] = """\
SELECT * FROM (VALUES ('1'), ('-1.5'), ('+2'), ('.5'), ('1.'), (''), ('1,250.5'), (',,'), ('1e3'), ('abc'),
  (' 1'), ('999.994'), ('999.995'), ('-999.995'), (CAST(NULL AS STRING)),
  ('123456789012345678901234567890123456789012345')) AS t(val)
"""

# Views each fixture depends on (in order), so a WITH prefix is minimal.
FIXTURE_DEPS = {
    "fx_inbound": [],
    "fx_stream": [],
    "fx_chunks": ["fx_stream"],
    "fx_positions": ["fx_inbound"],
    "fx_target": ["fx_inbound", "fx_positions"],
    "fx_targets": [],
    "fx_colmap": [],
    "fx_numeric": [],
}


def _closure(names):
    seen: list[str] = []

    def visit(n):
        for d in FIXTURE_DEPS[n]:
            visit(d)
        if n not in seen:
            seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_clause(*names: str) -> str:
    """``WITH fx_a AS (...), fx_b AS (...)`` for the oracle SQL (DuckDB)."""
    parts = [f"{n} AS (\n{FIXTURE_SQL[n].strip()}\n)" for n in _closure(names)]
    return "WITH " + ",\n".join(parts) + "\n"


def register(spark: SparkSession, sf_dir: str, tables=("lineitem", "events")) -> None:
    """Register driver tables and every fixture as temp views."""
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for name in _closure(FIXTURE_SQL):
        spark.sql(FIXTURE_SQL[name]).createOrReplaceTempView(name)


def fixture(spark: SparkSession, sf_dir: str, name: str):
    """One fixture as a DataFrame (registers views for ``sf_dir`` first)."""
    register(spark, sf_dir)
    return spark.table(name)
