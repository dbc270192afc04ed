"""All queries of the engine itself, by the ids of its operator inventory."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import answer_queries, composed_queries, graph_queries, lexical_queries, parse_queries, rag_queries, walk_queries

MODULES = [answer_queries, composed_queries, lexical_queries, graph_queries, parse_queries, rag_queries, walk_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
