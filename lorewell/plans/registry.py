"""Every registered query of the engine and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from lorewell.sources.relations import Relations

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Relations], DataFrame]], Callable[[Relations], DataFrame]]:
    """Registers a function of the relations under a name, with the SQL of its result where there is one."""

    def register(build: Callable[[Relations], DataFrame]) -> Callable[[Relations], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: build(Relations(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return build

    return register


for _module in ("quality", "catalog", "mutation", "retrieval", "chunking", "conversation", "service", "corpus", "stored", "twins"):
    import_module(f"lorewell.plans.{_module}")
