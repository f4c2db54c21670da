"""Catalogue of queries: a Spark builder, an SQL text for comparison where one exists, covered features."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: tuple[str, ...]


CATALOGUE: dict[str, Query] = {}


def query(covers: str, sql: str | None = None):
    def register(fn):
        CATALOGUE[fn.__name__] = Query(fn.__name__, fn, sql, tuple(covers.split()))
        return fn
    return register
