"""Registered queries: name -> (builder(spark, sf_dir) -> DataFrame, DuckDB oracle SQL | None).

Builders read the supplied tables (through the fixture views) and hand them to the
operators; the oracle is the same computation written as plain SQL over the same views.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import duckdb_with

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def register(name: str, views: list[str] | None = None, oracle: str | None = None, recursive: bool = False,
             same_as: str | None = None):
    """Decorator: register a query builder and, when given, its oracle SQL. ``oracle`` may
    start with ', name AS (...)' to add CTEs after the fixture views. ``same_as`` reuses the
    oracle of an already registered query (a stream checked against its batch form)."""
    def deco(fn: Builder) -> Builder:
        QUERIES[name] = fn
        if same_as is not None:
            ORACLES[name] = ORACLES[same_as]
        if oracle is not None:
            body = oracle.strip()
            text = duckdb_with(views).rstrip() + "\n" + body if views else body
            if recursive:
                text = "WITH RECURSIVE " + text[len("WITH "):]
            ORACLES[name] = text
        return fn
    return deco
