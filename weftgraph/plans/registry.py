"""A query with its SQL, kept side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.sources.graph import GRAPH_SQL, Graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, recursive: bool = False) -> Callable:
    """Registers a function of a `Graph`; `sql` may use its tables n, e, s, x and c."""

    def add(f: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Graph(spark, sf_dir))
        if sql:
            body = sql.strip()
            word = "RECURSIVE " if recursive else ""
            SQL[name] = f"WITH {word}{GRAPH_SQL}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {word}{GRAPH_SQL} {body}"
        return f

    return add
