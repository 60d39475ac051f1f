"""Registry of named queries: key -> (Spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    key: str
    build: Builder
    sql: str | None
    section: str


REGISTRY: dict[str, Entry] = {}


def register(key: str, section: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if key in REGISTRY:
            raise ValueError(f"duplicate query key {key}")
        REGISTRY[key] = Entry(key, fn, sql, section)
        return fn
    return deco


def load_all() -> dict[str, Entry]:
    # importing the modules fills the registry
    from . import gateway, authz_queries, audit_queries, finance_queries, streaming_queries, request_queries, span_queries, snapshot_queries  # noqa: F401
    return REGISTRY
