"""Query catalogue: name -> (Spark builder, optional DuckDB oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a catalogue query; ``sql`` is its independent DuckDB oracle."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    # importing the catalogue modules fills the registry
    from roadpulse.plans import (catalog_clean, catalog_eval, catalog_features,  # noqa: F401
                                 catalog_geo, catalog_graph, catalog_learn, catalog_queue,
                                 catalog_risk, catalog_sources, catalog_split, catalog_stream)
