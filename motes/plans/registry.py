"""Names of the ready-made queries, their Spark plans and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan; ``sql`` is the same query for an independent engine, if it can say it."""

    def add(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"two plans are called {name}")
        PLANS[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan

    return add
