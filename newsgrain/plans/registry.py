"""Where queries are registered: a name, a function of the model, and the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .model import Model, oracle

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *using: str) -> Callable:
    def register(f: Callable[[Model], DataFrame]) -> Callable[[Model], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Model(spark, sf_dir))
        if sql:
            SQL[name] = oracle(sql, *using)
        return f

    return register
