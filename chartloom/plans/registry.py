"""Registry of runnable queries: a Spark plan plus, where SQL can say it, the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    plan: Plan
    sql: str | None


_QUERIES: dict[str, Query] = {}


def query(name: str, *covers: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register ``plan`` under ``name``; ``covers`` lists the inventory rows it implements."""

    def add(plan: Plan) -> Plan:
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = Query(name, covers, plan, sql)
        return plan

    return add


def all_queries() -> dict[str, Query]:
    from chartloom.plans import catalog  # noqa: F401  (imports fill the registry)

    return dict(_QUERIES)
