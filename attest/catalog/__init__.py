"""Registered queries, each with the SQL it is checked against where SQL can say the same."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from . import answers, blocks, evaluation, evidence, files, monitoring, registry, retrieval, rich, stemming, tables  # noqa: F401

    return dict(QUERIES), dict(ORACLES)
