"""Scalar field helpers: JSON field extract (N1), ticket clean (N9), FIGI
fallback (N11).  All are built-in Column expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MESSAGE_MAP_TYPE = "map<string,string>"
FIGI_FALLBACK_PREFIX = "NOFIGI_ROW_ID_"


def parse_message(json_col: Column | str) -> Column:
    """JSON object text → map<string,string>; malformed text → NULL."""
    c = F.col(json_col) if isinstance(json_col, str) else json_col
    return F.from_json(c, MESSAGE_MAP_TYPE)


def json_field(msg_map: Column, source_column: str) -> Column:
    """Upper-case the source column name and look it up; missing → NULL."""
    return F.try_element_at(msg_map, F.lit(source_column.upper()))


def ticket_clean(col: Column | str) -> Column:
    """Trim, '0' → NULL, cast to BIGINT (bad text fails like the database)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.trim(c), F.lit("0")).cast("bigint")


def figi_fallback(figi: Column | str, row_id: Column | str) -> Column:
    """Keep rows addressable when the FIGI is missing."""
    f = F.col(figi) if isinstance(figi, str) else figi
    r = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.coalesce(f, F.concat(F.lit(FIGI_FALLBACK_PREFIX), r.cast("string")))
