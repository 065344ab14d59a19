"""Registry of named queries: a Spark plan builder plus its oracle SQL.

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
driver tables; the SQL is the DuckDB restatement over the same tables (or
``None`` where no SQL statement exists and a rows-only check applies).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    key: str
    build: Builder
    sql: str | None
    doc: str = ""


REGISTRY: dict[str, Query] = {}


def register(key: str, sql: str | None):
    def deco(fn: Builder) -> Builder:
        if key in REGISTRY:
            raise ValueError(f"duplicate query key {key}")
        REGISTRY[key] = Query(key, fn, sql, (fn.__doc__ or "").strip())
        return fn
    return deco


def load_all() -> dict[str, Query]:
    """Import every query module so its ``register`` calls run."""
    from . import q_archive, q_chunks, q_collection, q_enrich, q_html, q_ingest, q_layout, q_lifecycle, q_search, q_store, q_stream, q_tabular, q_text  # noqa: F401
    return REGISTRY
