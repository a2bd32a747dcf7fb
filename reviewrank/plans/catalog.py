"""The registered queries and, where SQL can say it, the statement each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register the decorated ``(spark, sf_dir) -> DataFrame`` under its own name or ``name``."""

    def register(fn):
        QUERIES[name or fn.__name__] = fn
        if sql is not None:
            ORACLES[name or fn.__name__] = sql
        return fn

    return register


def r6(c: Column | str) -> Column:
    """Six decimals, without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def r6s(names: list[str]) -> list[Column]:
    return [r6(n).alias(n) for n in names]


def sql_r6(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"
