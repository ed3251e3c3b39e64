"""Registry of the named queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from targetloom.plans.roles import Inputs, with_roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``fn(inputs) -> DataFrame`` under ``name``; ``sql`` is the equivalent check text."""

    def register(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Inputs(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return register


def check_texts() -> dict[str, str]:
    """Self-contained check texts; built after every role is known."""
    return {name: with_roles(sql) for name, sql in CHECKS.items()}
