"""Queries by name, each with its inventory ids and, where SQL can say it, a DuckDB text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    ids: tuple[str, ...]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Register a function ``(spark, sf_dir) -> DataFrame`` under a name."""

    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(fn, tuple(ids.split()), sql)
        return fn

    return keep


def rounded(df: DataFrame, cols: list[str], digits: int = 6) -> list:
    return [F.round(F.col(c), digits).alias(c) for c in cols]


def sql_rounded(cols: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)
