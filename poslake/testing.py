"""Order-insensitive result digests shared by the oracle checker and tests."""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math


def norm(v) -> str:
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f")
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    if isinstance(v, int):
        return str(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def digest(cols, rows):
    """(hash, sorted lines) of a result, columns taken in name order."""
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], lines


def duckdb_type(dt) -> str:
    """The DuckDB name of a Spark result type (for schema comparison)."""
    from pyspark.sql import types as T
    names = {T.StringType: "VARCHAR", T.LongType: "BIGINT", T.IntegerType: "INTEGER",
             T.BooleanType: "BOOLEAN", T.DateType: "DATE", T.TimestampNTZType: "TIMESTAMP",
             T.TimestampType: "TIMESTAMP WITH TIME ZONE", T.DoubleType: "DOUBLE"}
    if isinstance(dt, T.DecimalType):
        return f"DECIMAL({dt.precision},{dt.scale})"
    return names.get(type(dt), dt.simpleString())


def schema_mismatches(df, con, sql: str) -> dict:
    """Columns whose Spark type differs from the oracle's DuckDB type."""
    oracle = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return {f.name: (duckdb_type(f.dataType), oracle.get(f.name)) for f in df.schema.fields
            if duckdb_type(f.dataType) != oracle.get(f.name)}


def duckdb_connection(sf_dir: str):
    import duckdb

    from .fixtures import DRIVER_TABLES
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare_with_oracle(spark, sf_dir: str, fn, sql: str, con=None):
    """Run a query and its oracle; return (ok, detail)."""
    con = con or duckdb_connection(sf_dir)
    df = fn(spark, sf_dir)
    bad_types = schema_mismatches(df, con, sql)
    if bad_types:
        return False, f"types differ: {bad_types}"
    cols, rows = df.columns, [tuple(r) for r in df.collect()]
    res = con.execute(sql)
    ocols, orows = [d[0] for d in res.description], res.fetchall()
    if sorted(cols) != sorted(ocols):
        return False, f"columns differ: {sorted(cols)} vs {sorted(ocols)}"
    h1, l1 = digest(cols, rows)
    h2, l2 = digest(ocols, orows)
    if len(rows) != len(orows) or h1 != h2:
        s1, s2 = set(l1), set(l2)
        return False, (f"rows {len(rows)} vs {len(orows)}; spark-only {sorted(s1 - s2)[:2]}; "
                       f"oracle-only {sorted(s2 - s1)[:2]}")
    return True, f"{len(rows)} rows"
