"""Scratch storage and lineage cuts.

On a cluster the scratch folder is the shared one named by ``spark.checkpoint.dir``. A machine-local
folder is used only when the master itself is local.
"""

from __future__ import annotations

import tempfile
import uuid
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="broadloom-")
    return _LOCAL[sc.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name; nothing is ever overwritten."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Write once to the shared scratch folder and go on from the written table.

    This drops the lineage, survives lost executors (a re-read, not a recomputation) and, being Parquet,
    still lets later steps read single columns."""
    path = new_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def side_by_side(jobs, width: int = 4) -> list:
    """Run independent driver functions that start Spark jobs, a few at a time, results in order.

    Single fits leave a cluster idle between their stages; several at once fill it."""
    jobs = list(jobs)
    if len(jobs) < 2:
        return [j() for j in jobs]
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPool(min(width, len(jobs))) as pool:
        return pool.map(lambda j: j(), [inherit(j) for j in jobs])
