"""Registered queries: each operator applied to the shared tables, with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, sf_dir) under its name, with its SQL."""

    def add(fn: Query) -> Query:
        REGISTRY[name or fn.__name__] = (fn, sql)
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> dict[str, tuple[Query, str | None]]:
    """All queries, after their modules have been imported."""
    from quire.queries import layers, plans, relations, replays, search, segments, texts  # noqa: F401

    return REGISTRY
