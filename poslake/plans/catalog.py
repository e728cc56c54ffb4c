"""Registered queries: one per operator of the inventory.

Each entry pairs a Spark callable ``(spark, sf_dir) -> DataFrame`` built from
the library's operators with an oracle SQL text that DuckDB runs on the same
driver tables.  Column names are aliased identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .. import fixtures

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    name: str
    fn: QueryFn
    sql: str | None  # None → no SQL form (rows-only check)


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = Entry(name, fn, sql)
        return fn
    return deco


def with_fixtures(*names: str) -> str:
    return fixtures.with_clause(*names)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return fixtures.fixture(spark, sf_dir, name)


def queries() -> dict[str, QueryFn]:
    _import_all()
    return {k: e.fn for k, e in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _import_all()
    return {k: e.sql for k, e in REGISTRY.items() if e.sql is not None}


def _import_all():
    # Importing the modules fills REGISTRY.
    from . import q_compare, q_messages, q_netting, q_normalise, q_upsert  # noqa: F401
