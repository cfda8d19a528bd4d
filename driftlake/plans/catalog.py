"""The registry of named queries, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftlake.plans.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = (), ctes: str = ""):
    """Register a query; ``sql`` may use the named views and the extra CTEs."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            head = with_views(*views) if views else ""
            if ctes:
                head = f"{head}, {ctes}" if head else f"WITH {ctes}"
            ORACLE[name] = f"{head}\n{sql}".strip()
        return fn

    return register


def load() -> None:
    """Import every module that registers queries."""
    from driftlake.plans import inference, proto, registry, scrubbing, streams, traffic  # noqa: F401
