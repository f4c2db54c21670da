"""Kernel density on a grid."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, functions as F

#: Beyond so many bandwidths a Gaussian is below the resolution of a double.
REACH = 8.5
#: Cells in a bandwidth, and the highest power of the distance to a cell's middle. With distances of at most an eighth
#: of a bandwidth the ninth term of the expansion is below 1.09 * 8^-9 / sqrt(9!) = 1.4e-11 of the kernel's peak, and
#: all that are left out together below 2e-11.
CELLS, ORDER = 4, 8


def kernel_density(df: DataFrame, value: str, points: int = 200, bandwidth: float | None = None, by=()) -> DataFrame:
    """Gaussian density at ``points`` grid values between the extremes, within 2e-11 of the kernel's peak.

    Values are summed up in cells of a quarter of the bandwidth: count and eight moments around the cell's middle, in one
    aggregate. A cell's share at a grid point is the Hermite expansion of the Gaussian in these moments; cells meet only
    the grid points within reach. So what meets the grid grows with the spread in bandwidths, not with rows or values.
    Without a bandwidth Scott's rule, sd * n^(-1/5), is used.
    """
    by = list(by)
    r = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n"),
               F.stddev_samp(value).alias("sd")).first()
    if not r["n"]:
        return df.groupBy(*by).agg(F.lit(0).alias("g"), F.lit(0.0).alias("x"), F.lit(0.0).alias("density")).filter(F.lit(False))
    lo, hi = float(r["lo"]), float(r["hi"])
    h = bandwidth or (r["sd"] or 1.0) * r["n"] ** -0.2
    step = (hi - lo) / (points - 1) if points > 1 else 0.0

    v = F.col(value).cast("double")
    cell = F.floor((v - F.lit(lo)) * F.lit(CELLS / h))
    middle = F.lit(lo) + (F.col("__cell") + F.lit(0.5)) * F.lit(h / CELLS)
    off = (F.col("__v") - middle) / F.lit(h)
    powers = [F.lit(1.0)]
    for _ in range(ORDER):
        powers.append(powers[-1] * F.col("__d"))
    placed = df.filter(F.col(value).isNotNull()).select(*by, v.alias("__v"), cell.alias("__cell")).select(*by, "__cell", off.alias("__d"))
    moments = placed.groupBy(*by, "__cell").agg(F.count(F.lit(1)).alias("__c"), *[F.sum(p).alias(f"__m{k}") for k, p in enumerate(powers)])

    # exp(-(z - d)^2 / 2) = exp(-z^2 / 2) * sum He_k(z) d^k / k!; sorted by powers of z.
    weight = np.zeros((ORDER + 1, ORDER + 1))
    for k in range(ORDER + 1):
        c = np.polynomial.hermite_e.herme2poly([0] * k + [1]) / math.factorial(k)
        weight[:len(c), k] = c
    shares = [reduce(lambda a, b: a + b, [F.lit(float(w)) * F.col(f"__m{k}") for k, w in enumerate(row) if w]).alias(f"__a{j}") for j, row in enumerate(weight)]
    if step > 0:
        at = lambda d: F.least(F.greatest((F.col("__x") + F.lit(d - lo)) / F.lit(step), F.lit(0.0)), F.lit(points - 1.0))
        near = F.sequence(F.floor(at(-REACH * h)).cast("int"), F.ceil(at(REACH * h)).cast("int"))
    else:
        near = F.sequence(F.lit(0), F.lit(points - 1))
    grid = F.lit(lo) + F.col("g") * F.lit(step)
    cells = moments.select(*by, middle.alias("__x"), *shares).withColumn("g", F.explode(near)).withColumn("__z", (grid - F.col("__x")) / F.lit(h))
    poly = reduce(lambda a, j: a * F.col("__z") + F.col(f"__a{j}"), range(ORDER - 1, -1, -1), F.col(f"__a{ORDER}"))
    sums = cells.groupBy(*by, "g").agg(F.sum(poly * F.exp(-0.5 * F.col("__z") * F.col("__z"))).alias("__k"))
    # Every grid point of every group, those out of everything's reach included.
    size = moments.groupBy(*by).agg(F.sum("__c").alias("__n")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    out = size.join(sums, [*by, "g"], "left")
    return out.select(*by, "g", grid.alias("x"),
                      (F.coalesce("__k", F.lit(0.0)) / (F.col("__n") * F.lit(h * math.sqrt(2 * math.pi)))).alias("density"))
