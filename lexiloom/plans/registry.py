"""Registry of the named queries, their inventory IDs and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


def register(name: str, covers: str, sql: str | None = None):
    """Decorator: adds a (spark, sf_dir) query under ``name``."""
    def add(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        COVERS[name] = tuple(covers.split())
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table_fn(spark: SparkSession, sf_dir: str):
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
