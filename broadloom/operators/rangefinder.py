"""Leading components of very wide arrays: randomized range finder and a tall-skinny QR tree.

No p x p matrix is built. A pass multiplies the rows with l directions and back, p x l numbers in all; passes repeat until
the directions stand. Then each task reduces its rows, seen in these directions, to a triangle of l x l by QR batch after
batch, triangles are reduced pair by pair on the executors, and the last one's singular values are those of the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from broadloom.operators.decompose import Projection, fix_signs
from broadloom.operators.gram import FAN, batch_matrix, sum_batches

FEATURES = "__x"


def _rows(df: DataFrame, features: str, width: int) -> DataFrame:
    x = F.col(features).cast("array<double>")
    return df.select(x.alias(FEATURES)).filter(F.col(FEATURES).isNotNull() & (F.size(FEATURES) == width) & F.forall(FEATURES, lambda v: v.isNotNull()))


def triangle(rows: DataFrame, transform, size: int) -> np.ndarray:
    """R of the QR decomposition of ``transform(batch matrix)`` over all rows, ``size`` columns."""
    def reduced(blocks):
        r = np.zeros((0, size))
        for z in blocks:
            r = np.linalg.qr(np.vstack([r, z]), mode="r")
        if len(r):
            yield pa.record_batch([pa.array([r.ravel()], pa.list_(pa.float64()))], names=["r"])

    def leaves(batches):
        return reduced(transform(b.column(FEATURES)) for b in batches if b.num_rows)

    def nodes(batches):
        return reduced(np.asarray(v, float).reshape(-1, size) for b in batches for v in b.column("r").to_pylist())

    parts = rows.mapInArrow(leaves, "r array<double>").withColumn("s", F.spark_partition_id() % FAN)
    top = parts.repartition("s").select("r").mapInArrow(nodes, "r array<double>").collect()  # at most FAN triangles
    found = [np.asarray(t["r"], float).reshape(-1, size) for t in top]
    return np.linalg.qr(np.vstack(found), mode="r") if found else np.zeros((0, size))


def leading(train: DataFrame, features: str, width: int, k: int, centre: bool = True, scale: bool = False, oversample: int = 10,
            passes: int = 40, tol: float = 1e-9, seed: int = 0, prefix: str = "pca") -> Projection:
    """The ``k`` leading right singular vectors of the (centred, scaled) rows, signs as elsewhere.

    ``info`` has the singular values, the passes made and the last relative change of the k values they estimate; passes
    end when that is below ``tol``, after ``passes`` at the latest. Rows that are NULL, hold one or have another width
    play no part. Scaling divides by the sample deviation, constant columns by one.
    """
    rows = _rows(train, features, width)
    mean, sd = np.zeros(width), np.ones(width)
    size = min(width, k + oversample)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, size)))[0]
    none = rows.isEmpty()
    if not none and (centre or scale):
        row = rows.agg(Summarizer.metrics("mean", "variance").summary(array_to_vector(FEATURES)).alias("m")).first()["m"]
        mean = row["mean"].toArray() if centre else mean
        sd = np.sqrt(row["variance"].toArray()) if scale else sd
        sd = np.where(sd > 0, sd, 1.0)
    if none:
        return Projection(prefix, mean, np.zeros((width, k)), {"singular": np.zeros(k), "passes": 0, "change": 0.0})
    view = lambda column: (batch_matrix(column, width) - mean) / sd
    before, change, made = None, np.inf, 0
    while size < width and made < passes and change > tol:
        def back(b, q=q):
            x = view(b.column(FEATURES))
            return (x.T @ (x @ q)).ravel()

        b = sum_batches(rows, back, [FEATURES]).reshape(width, size)
        now = np.sort(np.linalg.eigvalsh(q.T @ b))[::-1][:k]
        change = np.inf if before is None else float(np.max(np.abs(now - before)) / max(now[0], 1e-300))
        q, before, made = np.linalg.qr(b)[0], now, made + 1
    r = triangle(rows, lambda column, q=q: view(column) @ q, size)
    _, s, w = np.linalg.svd(r)
    v = fix_signs(q @ w.T[:, :k])
    info = {"singular": np.append(s, np.zeros(k))[:k], "passes": made, "change": change if made else 0.0}
    return Projection(prefix, mean, v / sd[:, None], info)
