"""All registered queries of the engine itself, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that says the same."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _loaded() -> None:
    from . import analysis, codes, facts, graphs, relations, search, stores, streams, tracing  # noqa: F401


def queries() -> dict:
    _loaded()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _loaded()
    return ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["pagerank_fixed"](spark, sf_dir)
