"""The queries of this subpackage: a Spark builder and, where SQL can follow, its twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class TextQuery:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


TEXT_QUERIES: dict[str, TextQuery] = {}


def text_query(sql: str | None = None):
    def register(fn):
        TEXT_QUERIES[fn.__name__] = TextQuery(fn, sql)
        return fn
    return register
