"""Centroid clustering of integer vectors, with an n-simplex projection that spares most exact distances.

The distances of a vector to some pivots fix the apex of a simplex over them: its coordinates within the pivots' hull
and its altitude above it. The Euclidean distance of two apexes is at most the distance of the two vectors; with one
apex mirrored below the hull it is at least that. So apexes, computed once from cached distances, tell for each vector
which centroids can be nearest at all; only those are compared, exactly, in integers. The pivots are the centroids of
the round that fixes them; once the centroids have moved so far that the bounds leave more than half of them, the
next round takes them as new pivots and its distances as the new cache.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from broadloom.llm.common import slices
from broadloom.session import durable

#: Integer components stay below this in magnitude, so that squared distances fit 64 bits.
MOST = 1 << 27
BATCH = 2048
#: Pivots this much closer to the hull of the others than the farthest one add rounding errors, not knowledge.
FLAT = 1e-3
#: Share of the squared lengths by which bounds may be off: apexes are stored as 32-bit floats.
SLACK = 1e-5


class Simplex:
    """Base simplex over pivots chosen among ``points``, each the farthest from the hull of those before it."""

    def __init__(self, points: np.ndarray):
        base = points[0].astype(np.float64)
        left = points - base
        chosen, axes, first = [0], [], None
        while len(chosen) < len(points):
            far = (left * left).sum(1)
            i = int(far.argmax())
            height = float(np.sqrt(far[i]))
            first = first or height
            if height <= FLAT * first or height < 1e-6:
                break
            axis = left[i] / height
            left = left - np.outer(left @ axis, axis)
            chosen.append(i)
            axes.append(axis)
        self.pivots = points[chosen].astype(np.int64)
        corners = (self.pivots[1:] - base) @ np.array(axes).reshape(len(axes), -1).T
        self.lengths = (corners * corners).sum(1)
        self.inverse = np.linalg.inv(corners) if len(corners) else np.zeros((0, 0))

    def apexes(self, vectors: np.ndarray) -> np.ndarray:
        """One row per vector: coordinates in the hull, then the altitude, from its squared distances to the pivots."""
        d = np.stack([squared(vectors, p) for p in self.pivots], 1).astype(np.float64)
        inside = 0.5 * (d[:, :1] - d[:, 1:] + self.lengths) @ self.inverse.T
        return np.c_[inside, np.sqrt(np.maximum(d[:, 0] - (inside * inside).sum(1), 0))]


def squared(vectors: np.ndarray, point: np.ndarray) -> np.ndarray:
    off = vectors - point
    return np.einsum("ij,ij->i", off, off)


def possible(apexes: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of ``others`` can be the nearest to each of ``apexes``: lower bound within the least upper bound."""
    a, b = apexes.astype(np.float64), others
    size = (a * a).sum(1)[:, None] + (b * b).sum(1)
    low = size - 2 * a @ b.T
    high = low + 4 * a[:, -1:] * b[:, -1]
    return low - SLACK * size <= (high + SLACK * size).min(1, keepdims=True)


def nearest(vectors: np.ndarray, centroids: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest number among the nearest of the open centroids, and the squared distance."""
    best, at = np.full(len(vectors), np.iinfo(np.int64).max), np.zeros(len(vectors), np.int32)
    for j, c in enumerate(centroids):
        rows = np.flatnonzero(open_[:, j])
        d = squared(vectors[rows], c)
        nearer = d < best[rows]
        best[rows[nearer]], at[rows[nearer]] = d[nearer], j
    return at, best


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _project(sent, batches):
    simplex = sent.value
    for batch in slices(batches, BATCH):
        if batch.num_rows:
            x = simplex.apexes(_matrix(batch.column("v"), batch.num_rows).astype(np.int64)).astype(np.float32)
            yield pa.record_batch([batch.column("id"), batch.column("v"), pa.array(list(x), pa.list_(pa.float32()))], names=["id", "v", "apex"])


def _assigned(sent, batches):
    simplex, centroids = sent.value
    others = simplex.apexes(centroids)
    for batch in slices(batches, BATCH):
        if batch.num_rows:
            v = _matrix(batch.column("v"), batch.num_rows).astype(np.int64)
            open_ = possible(_matrix(batch.column("apex"), batch.num_rows), others)
            yield batch, v, open_, *nearest(v, centroids, open_)


def _sums(sent, batches):
    """(cluster, place, total): componentwise sums and, at place -1, sizes; at cluster -1 the comparisons made."""
    k, dim = sent.value[1].shape
    totals, made = np.zeros((k, dim + 1), np.int64), 0
    for _, v, open_, at, _ in _assigned(sent, batches):
        order = np.argsort(at, kind="stable")
        found, starts = np.unique(at[order], return_index=True)
        totals[found, 1:] += np.add.reduceat(v[order], starts)
        totals[:, 0] += np.bincount(at, minlength=k)
        made += int(open_.sum())
    cluster, place = np.divmod(np.arange(k * (dim + 1)), dim + 1)
    yield pa.record_batch([pa.array(np.r_[cluster, -1].astype(np.int32)), pa.array(np.r_[place - 1, -1].astype(np.int32)),
                           pa.array(np.r_[totals.ravel(), made])], names=["cluster", "place", "total"])


def _labels(sent, batches):
    for batch, _, _, at, far in _assigned(sent, batches):
        yield pa.record_batch([batch.column("id"), pa.array(at), pa.array(far)], names=["id", "cluster", "distance"])


def cluster_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dim: int = 64, k: int = 40,
                    rounds: int = 5, scale: int = 256, seed: str = "2") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row per vector kept.

    Kept are vectors of exactly ``dim`` components, none NULL, NaN or infinite; each component becomes
    floor(scale * x), which must stay below 2^27 in magnitude (a row beyond that takes no part: its distances would not
    fit 64 bits). The ``k`` kept rows with the smallest SHA-256 of "<seed>:<vec_id>" start as centroids, fewer if there
    are fewer; rows of one id are told apart by their components, and rows with a NULL id start none but belong to a
    cluster. Rows that repeat are rows of their own. Ties go to the smaller centroid number; an empty cluster keeps its
    centroid. Nothing kept gives no rows.

    Each round is one pass over the written table; tasks hand on k x (dim + 1) sums each, added on the executors, so
    the driver sees k x (dim + 1) numbers a round whatever the number of vectors.
    """
    spark = vectors.sparkSession
    schema = "id bigint, v array<int>, apex array<float>"
    ints = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))
    usable = (F.size(vector) == dim) & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double") * scale) < float(MOST), F.lit(False)))
    kept = vectors.filter(F.col(vector).isNotNull() & usable).select(F.col(vec_id).cast("bigint").alias("id"), ints.cast("array<int>").alias("v"))
    kept = durable(kept)
    start = kept.filter("id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    centroids = np.array([r.v for r in start.orderBy("h", "v").limit(k).select("v").collect()], np.int64).reshape(-1, dim)
    kind = vectors.schema[vec_id].dataType
    if not len(centroids):
        if not kept.isEmpty():
            raise ValueError("no row with an id: nothing can start a centroid")
        return kept.select(F.col("id").cast(kind).alias("vec_id"), *[F.lit(None).cast(t).alias(n) for n, t in (
            ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string"))])
    stale = True
    for turn in range(rounds + 1):
        if stale:
            simplex = Simplex(centroids)
            cached = durable(kept.mapInArrow(partial(_project, spark.sparkContext.broadcast(simplex)), schema))
        sent = spark.sparkContext.broadcast((simplex, centroids))
        if turn == rounds:
            break
        sums = cached.mapInArrow(partial(_sums, sent), "cluster int, place int, total bigint").groupBy("cluster", "place").agg(
            F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        got = {(r.cluster, r.place): int(r.total) for r in sums.collect()}  # k x (dim + 1) numbers
        centroids = np.array([[got[j, i] // got[j, -1] for i in range(dim)] if got[j, -1] else centroids[j] for j in range(len(centroids))], np.int64)
        stale = 2 * got[-1, -1] > len(centroids) * sum(got[j, -1] for j in range(len(centroids)))
    labels = durable(cached.mapInArrow(partial(_labels, sent), "id bigint, cluster int, distance bigint"))
    inertia = {r.cluster: int(r.s) for r in labels.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    clusters = spark.createDataFrame([(j, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest())
                                      for j, s in inertia.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return labels.join(F.broadcast(clusters), "cluster").select(  # k rows
        F.col("id").cast(kind).alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
