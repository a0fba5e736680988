"""Registry of queries: a plan over the views, and the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tileflow.sources.views import Views, with_views

Plan = Callable[[Views], DataFrame]
PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Plan], Plan]:
    def register(plan: Plan) -> Plan:
        key = name or plan.__name__
        assert key not in PLANS, key
        PLANS[key] = plan
        if sql:
            SQL[key] = with_views(sql)
        return plan

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tileflow.plans import addressing, arrivals, batch, counters, queueing, serving, storage  # noqa: F401

    return {k: (lambda spark, sf_dir, p=p: p(Views(spark, sf_dir))) for k, p in PLANS.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
