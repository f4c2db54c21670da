"""Latent components of an array column: fitted on the training rows, applied to any rows.

A fit needs only aggregates of fixed size (a p x p matrix, or k x p sums per step). Scoring is one Arrow
batch product, so appending components never shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.feature import ElementwiseProduct, PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, functions as F

from broadloom.operators.gram import batch_matrix, gram_array, sum_batches


def feature_array(cols):
    return F.array(*[F.col(c).cast("double") for c in cols])


@dataclass
class Projection:
    """components = (x - mean) @ matrix; the mean may be zero."""
    prefix: str
    mean: np.ndarray
    matrix: np.ndarray
    info: dict

    def transform(self, df: DataFrame, features: str, out: str | None = None) -> DataFrame:
        mean, matrix = self.mean, self.matrix
        p, k = matrix.shape

        @F.arrow_udf("array<double>")
        def project(x: pa.Array) -> pa.Array:
            z = (batch_matrix(x, p) - mean) @ matrix
            offsets = pa.array(np.arange(0, (len(z) + 1) * k, k, dtype=np.int32))
            return pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))

        return df.withColumn(out or self.prefix, project(F.col(features).cast("array<double>")))


def fix_signs(v: np.ndarray) -> np.ndarray:
    """Flip columns so that the loading of largest magnitude is positive."""
    s = np.sign(v[np.argmax(np.abs(v), axis=0), np.arange(v.shape[1])])
    return v * np.where(s == 0, 1.0, s)


def append_components(df: DataFrame, column: str, k: int, drop: bool = True) -> DataFrame:
    """Array column -> ``<column>_1`` .. ``<column>_k``."""
    out = df.select("*", *[F.element_at(column, i).alias(f"{column}_{i}") for i in range(1, k + 1)])
    return out.drop(column) if drop else out


class FittedPCA:
    def __init__(self, scaler, model, flip, prefix):
        self.scaler, self.model, self.flip, self.prefix = scaler, model, flip, prefix
        self.ratio = model.explainedVariance.toArray()

    def transform(self, df: DataFrame, features: str, out: str | None = None) -> DataFrame:
        x = df.withColumn("__v", array_to_vector(F.col(features).cast("array<double>")))
        x = self.flip.transform(self.model.transform(self.scaler.transform(x)))
        return x.withColumn(out or self.prefix, vector_to_array("__f")).drop("__v", "__c", "__p", "__f")


def pca(train: DataFrame, features: str, k: int, scale: bool = False, prefix: str = "pca") -> FittedPCA:
    """Centred (and optionally scaled) principal components."""
    x = train.select(array_to_vector(F.col(features).cast("array<double>")).alias("__v"))
    scaler = StandardScaler(withMean=True, withStd=scale, inputCol="__v", outputCol="__c").fit(x)
    model = PCA(k=k, inputCol="__c", outputCol="__p").fit(scaler.transform(x))
    pc = model.pc.toArray()
    signs = np.sign(pc[np.argmax(np.abs(pc), axis=0), np.arange(pc.shape[1])])
    flip = ElementwiseProduct(scalingVec=Vectors.dense(np.where(signs == 0, 1.0, signs)), inputCol="__p", outputCol="__f")
    return FittedPCA(scaler, model, flip, prefix)


def pca_cut(train: DataFrame, features: str, width: int, tol: float = 0.25, keep: int = 5):
    """Scaled components whose deviation is at least ``tol`` of the first one's, at most ``keep``."""
    fitted = pca(train, features, width, scale=True)
    sd = np.sqrt(fitted.ratio)
    k = int(min(keep, np.sum(sd > tol * sd[0])))
    return fitted, k


def truncated_svd(train: DataFrame, features: str, k: int, prefix: str = "tsvd") -> Projection:
    """Leading right singular vectors of the uncentred rows."""
    x = MLUtils.convertVectorColumnsFromML(
        train.select(array_to_vector(F.col(features).cast("array<double>")).alias("v")))
    svd = RowMatrix(x).computeSVD(k, computeU=False)
    v = fix_signs(np.asarray(svd.V.toArray()))
    return Projection(prefix, np.zeros(v.shape[0]), v, {"singular": svd.s.toArray()})


def gaussian_projection(width: int, k: int, seed: int = 42, prefix: str = "grp") -> Projection:
    m = np.random.default_rng(seed).normal(0.0, 1.0 / np.sqrt(k), (width, k))
    return Projection(prefix, np.zeros(width), m, {})


def sparse_projection(width: int, k: int, seed: int = 42, prefix: str = "srp") -> Projection:
    """Entries are 0, or +-sqrt(s / k) with probability 1 / 2s each, s = sqrt(width)."""
    s = np.sqrt(width)
    u = np.random.default_rng(seed).random((width, k))
    m = np.where(u < 0.5 / s, 1.0, np.where(u < 1.0 / s, -1.0, 0.0)) * np.sqrt(s / k)
    return Projection(prefix, np.zeros(width), m, {})


def fast_ica(train: DataFrame, features: str, width: int, k: int, max_iter: int = 1000, tol: float = 0.008,
             seed: int = 42, prefix: str = "ica") -> Projection:
    """Independent components: whiten from one Gram pass, then one aggregate per fixed-point step."""
    n, s, g = gram_array(train, features, width).sums()
    mean = s / n
    ev, u = np.linalg.eigh(g / n - np.outer(mean, mean))
    order = np.argsort(-ev)[:k]
    white = u[:, order] / np.sqrt(np.maximum(ev[order], 1e-12))
    z = Projection("z", mean, white, {}).transform(train, features).select("z").persist(StorageLevel.MEMORY_AND_DISK)

    def decorrelate(w):
        e, v = np.linalg.eigh(w @ w.T)
        return (v / np.sqrt(np.maximum(e, 1e-12))) @ v.T @ w

    slices = z.rdd.getNumPartitions()
    w = decorrelate(np.random.default_rng(seed).normal(size=(k, k)))
    steps = 0
    try:
        for steps in range(1, max_iter + 1):
            def step(b, w=w):
                x = batch_matrix(b.column("z"), k)
                t = np.tanh(x @ w.T)
                return np.concatenate([(t.T @ x).ravel(), (1 - t * t).sum(axis=0)])

            v = sum_batches(z, step, ["z"], slices) / n
            new = decorrelate(v[:k * k].reshape(k, k) - v[k * k:, None] * w)
            gap = float(np.max(np.abs(np.abs(np.sum(new * w, axis=1)) - 1)))
            w = new
            if gap < tol:
                break
    finally:
        z.unpersist()
    return Projection(prefix, mean, fix_signs(white @ w.T), {"steps": steps, "gap": gap})


def _nonneg_rows(x: np.ndarray, h: np.ndarray, sweeps: int) -> np.ndarray:
    """Non-negative least squares of every row of x on the rows of h, by cyclic descent."""
    hh, xh = h @ h.T, x @ h.T
    w = np.maximum(xh / np.maximum(hh.sum(axis=1), 1e-12), 0.0)
    for _ in range(sweeps):
        for j in range(len(h)):
            if hh[j, j] > 1e-12:
                w[:, j] = np.maximum(w[:, j] - (w @ hh[:, j] - xh[:, j]) / hh[j, j], 0.0)
    return w


class FittedNMF:
    def __init__(self, h, losses, sweeps, prefix):
        self.h, self.losses, self.sweeps, self.prefix = h, losses, sweeps, prefix

    def transform(self, df: DataFrame, features: str, out: str | None = None) -> DataFrame:
        h, sweeps = self.h, self.sweeps
        k, p = h.shape

        @F.arrow_udf("array<double>")
        def solve(x: pa.Array) -> pa.Array:
            w = _nonneg_rows(np.abs(batch_matrix(x, p)), h, sweeps)
            return pa.ListArray.from_arrays(
                pa.array(np.arange(0, (len(w) + 1) * k, k, dtype=np.int32)), pa.array(w.ravel()))

        return df.withColumn(out or self.prefix, solve(F.col(features).cast("array<double>")))


def nmf(train: DataFrame, features: str, width: int, k: int, max_iter: int = 250, tol: float = 1e-4,
        seed: int = 42, sweeps: int = 30, prefix: str = "nmf") -> FittedNMF:
    """Non-negative factors of |X|. Row weights are solved afresh inside each pass, so a step leaves only
    the k x k and k x p sums behind and no lineage builds up."""
    x = train.select(F.transform(F.col(features).cast("array<double>"), F.abs).alias("x")) \
             .persist(StorageLevel.MEMORY_AND_DISK)
    slices = x.rdd.getNumPartitions()
    rng = np.random.default_rng(seed)
    n, s, g = gram_array(x, "x", width).sums()
    h = np.abs(rng.normal(size=(k, width))) * np.sqrt(max(s.mean() / n, 1e-12) / k)
    total, losses = float(np.trace(g)), []
    try:
        for _ in range(max_iter):
            def step(b, h=h):
                m = batch_matrix(b.column("x"), width)
                w = _nonneg_rows(m, h, sweeps)
                return np.concatenate([(w.T @ w).ravel(), (w.T @ m).ravel()])

            v = sum_batches(x, step, ["x"], slices)
            a, b = v[:k * k].reshape(k, k), v[k * k:].reshape(k, width)
            losses.append(total - 2 * float(np.sum(b * h)) + float(np.sum(a * (h @ h.T))))
            for _ in range(sweeps):
                for j in range(k):
                    if a[j, j] > 1e-12:
                        h[j] = np.maximum(h[j] - (a[j] @ h - b[j]) / a[j, j], 0.0)
            if len(losses) > 1 and losses[-2] - losses[-1] < tol * max(losses[0], 1e-300):
                break
    finally:
        x.unpersist()
    return FittedNMF(h.copy(), losses, sweeps, prefix)
