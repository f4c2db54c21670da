"""Small helpers shared by the text operators."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; every other character stays, whatever the locale or the Unicode version."""
    return F.translate(c, UPPER, LOWER)


def crc_mod(c: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n."""
    return F.crc32(c.cast("string").cast("binary")) % n


def worker_state(name: str, make):
    """An object kept by the Python worker from one task to the next; ``make`` builds it on first use."""
    home = sys.modules.setdefault("broadloom_worker_state", types.ModuleType("broadloom_worker_state"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)


def slices(batches, rows: int = 256):
    """Record batches in slices of few rows: what a task unpacks and hands back at a time stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
