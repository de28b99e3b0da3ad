"""All queries of the library proper, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.fixtures import TABLES, frame, with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, *views: str, sql: str | None = None):
    """Register a function of the views as a query. sql: a SELECT over the views, or further common table expressions and one (after RECURSIVE, if they are)."""

    def register(f: Callable[..., DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(*(frame(spark, sf_dir, v) for v in views))
        if sql:
            text = sql.strip()
            own = [v for v in views if v not in TABLES]
            first = "WITH "
            if text.startswith("RECURSIVE "):
                first, text = "WITH RECURSIVE ", text.removeprefix("RECURSIVE ")
            if text.upper().startswith("SELECT"):
                ORACLE_SQL[name] = (with_views(*own) + " " if own else "") + text
            else:
                ORACLE_SQL[name] = (first + with_views(*own).removeprefix("WITH ") + ", " if own else first) + text
        return f

    return register


def load() -> None:
    """Import the modules that register queries."""
    from tidemark.plans import eventlog, inventory, latency, reconcile, runstate, sampling, sources, streams  # noqa: F401
