"""Registry of named queries: name -> (spark, sf_dir) -> DataFrame, with DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register the decorated (spark, sf_dir) function under ``name``."""

    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def load() -> None:
    """Import the modules that register queries."""
    from importlib import import_module

    for name in MODULES:
        import_module(f"quillspan.plans.{name}")


MODULES = ("lexical", "retrieval", "graph", "chunking", "catalog", "rules", "scalars", "records", "evidence", "audits", "reads", "stored", "tuning", "replay")
