"""Wide factors as dummy columns that are never written out: sparse cross products, and ridge regression on them.

A row has a handful of entries that are not zero: the intercept, its numbers, one dummy per factor. Their products are
added up per pair of columns on the executors, so the work depends on entries a row and the result on pairs of columns
that meet, not on the square of the number of columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from broadloom.operators.lookup import Levels
from broadloom.session import durable

#: So many cells of a cross product are solved on the driver, more where they lie; the vector of coefficients is on the
#: driver either way.
DRIVER_CELLS = 2_000_000


@dataclass
class SparseGram:
    """(i, j, v) with i <= j: products of columns; j = -1: products with the target. Column 0 is the intercept, then come
    the numbers, then the levels of each factor in sorted order."""
    cells: DataFrame
    levels: Levels
    numbers: list[str]
    factors: list[str]
    width: int

    def columns(self) -> DataFrame:
        """(at, column, level) of every dummy."""
        return self.levels.frame.select("at", "column", "level")


def sparse_gram(df: DataFrame, numbers, factors, y: str, key: str) -> SparseGram:
    """Cross products of an intercept, ``numbers`` and one dummy per level of each of ``factors``.

    A NULL level has no dummy; rows with a NULL number or target are left out. Dictionaries are broadcast while small and
    joined otherwise, one join per factor.
    """
    numbers, factors = list(numbers), list(factors)
    data = df.na.drop(subset=[*numbers, y])
    levels = Levels(data, factors, key).number()
    counts = {r["column"]: r["count"] for r in levels.frame.groupBy("column").count().collect()}
    start, offset = {}, 1 + len(numbers)
    for c in factors:
        start[c], offset = offset, offset + counts.get(c, 0)
    first = F.lit(0)
    for c in factors:
        first = F.when(F.col("column") == c, F.lit(start[c])).otherwise(first)
    levels.frame = durable(levels.frame.withColumn("at", (F.col("code") + first).cast("bigint")))
    rows = data.select(key, F.col(y).cast("double").alias("__y"), *numbers, *factors)
    for k, c in enumerate(factors):
        rows = levels.attach(rows.withColumn(c, F.col(c).cast("string")), c, **{f"__at{k}": "at"})
    entry = lambda i, v: F.struct(i.cast("bigint").alias("i"), v.cast("double").alias("v"))
    entries = [entry(F.lit(0), F.lit(1.0))] + [entry(F.lit(1 + k), F.col(c)) for k, c in enumerate(numbers)]
    entries += [entry(F.col(f"__at{k}"), F.lit(1.0)) for k in range(len(factors))]
    pairs = [F.struct(a["i"].alias("i"), b["i"].alias("j"), (a["v"] * b["v"]).alias("v")) for n, a in enumerate(entries) for b in entries[n:]]
    pairs += [F.struct(a["i"].alias("i"), F.lit(-1).cast("bigint").alias("j"), (a["v"] * F.col("__y")).alias("v")) for a in entries]
    cells = rows.select(F.explode(F.array(*pairs)).alias("c")).select("c.*").filter("i is not null and j is not null")
    return SparseGram(durable(cells.groupBy("i", "j").agg(F.sum("v").alias("v"))), levels, numbers, factors, offset)


def _times(i, j, v, x):
    """Product of the symmetric cells with a vector."""
    return np.bincount(i, v * x[j], len(x)) + np.bincount(j, np.where(i == j, 0.0, v) * x[i], len(x))


def _partial_product(sent, batches):
    x = sent.value
    out = np.zeros(len(x))
    for b in batches:
        out += _times(*(b.column(c).to_numpy() for c in "ijv"), x)
    some = np.flatnonzero(out)
    yield pa.record_batch([pa.array(some), pa.array(out[some])], names=["i", "v"])


@dataclass
class SparseLinear:
    """Intercept, coefficients of the numbers, and the level table with a coefficient each."""
    intercept: float
    coef: dict[str, float]
    levels: Levels
    factors: list[str]
    steps: int

    def transform(self, df: DataFrame, out: str = "pred") -> DataFrame:
        """A level without a coefficient, and NULL, count nothing."""
        score = reduce(lambda a, c: a + F.lit(self.coef[c]) * F.col(c), self.coef, F.lit(self.intercept))
        added = []
        for k, c in enumerate(self.factors):
            df = self.levels.attach(df.withColumn(f"__l{k}", F.col(c).cast("string")).withColumnRenamed(c, f"__c{k}").withColumnRenamed(f"__l{k}", c),
                                    c, **{f"__w{k}": "coef"}).drop(c).withColumnRenamed(f"__c{k}", c)
            score = score + F.coalesce(F.col(f"__w{k}"), F.lit(0.0))
            added.append(f"__w{k}")
        return df.withColumn(out, score).drop(*added)


def sparse_ridge(g: SparseGram, alpha: float = 1.0, tol: float = 1e-12, most_steps: int = 1_000) -> SparseLinear:
    """Ridge on all columns but the intercept, by conjugate gradients scaled by the diagonal.

    A step is one product of the cells with a vector: where they lie, unless there are few. Raises if ``tol`` (of the
    residual, relative) is not reached.
    """
    spark = g.cells.sparkSession
    edge = g.cells.filter("j = -1 or i = j").toArrow()  # two numbers per column
    i, j, v = (edge.column(c).to_numpy() for c in "ijv")
    right, diagonal = np.zeros(g.width), np.full(g.width, float(alpha))
    right[i[j < 0]] = v[j < 0]
    diagonal[0] = 0.0
    diagonal[i[j >= 0]] += v[j >= 0]
    penalty = np.full(g.width, float(alpha))
    penalty[0] = 0.0
    inner = g.cells.filter("j >= 0")
    if inner.count() <= DRIVER_CELLS:
        got = inner.toArrow()
        fixed = [got.column(c).to_numpy() for c in "ijv"]
        product = lambda x: _times(*fixed, x) + penalty * x
    else:
        def product(x):
            sent = spark.sparkContext.broadcast(x)
            got = inner.mapInArrow(partial(_partial_product, sent), "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
            out = penalty * x
            out[got.column("i").to_numpy()] += got.column("v").to_numpy()
            sent.unpersist()
            return out

    scale = np.where(diagonal > 0, diagonal, 1.0)
    w = np.zeros(g.width)
    r = right.copy()
    z = r / scale
    p, rz, goal, steps = z.copy(), float(r @ z), tol * max(float(np.linalg.norm(right)), 1e-300), 0
    while np.linalg.norm(r) > goal:
        if steps == most_steps:
            raise ValueError(f"{most_steps} steps left a residual of {np.linalg.norm(r):.3g}")
        q = product(p)
        step = rz / float(p @ q)
        w, r = w + step * p, r - step * q
        z = r / scale
        rz, before = float(r @ z), rz
        p, steps = z + rz / before * p, steps + 1
    table = spark.createDataFrame(pa.table({"at": pa.array(np.arange(g.width)), "coef": pa.array(w)}))
    levels = Levels.__new__(Levels)
    levels.max_rows, levels.small = g.levels.max_rows, g.levels.small
    levels.frame = durable(g.levels.frame.join(table, "at"))
    return SparseLinear(float(w[0]), dict(zip(g.numbers, map(float, w[1:]))), levels, g.factors, steps)
