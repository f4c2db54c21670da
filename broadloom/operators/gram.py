"""Per-fold cross-product pass: n, sums and X'X with the target as the last column.

Every closed-form fit, fold score, correlation matrix and co-occurrence count of the package is read off
this one distributed aggregate. Its result is p x p per fold and bounded by ``MAX_FEATURES``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F, types as T

MAX_FEATURES = 5_000
SQL_FEATURES = 5           # up to here plain SQL sums stay inside generated code


@dataclass
class Moments:
    """Centred moments of the features and the target."""
    n: float
    mean: np.ndarray
    y_mean: float
    sxx: np.ndarray
    sxy: np.ndarray
    syy: float
    raw_xx: np.ndarray
    raw_xy: np.ndarray


class Gram:
    """Sums per fold of the columns less ``shift``; folds can be added up or left out without touching the data again.

    The shift is a value in the midst of each column, so that nothing is lost where a spread is small beside the
    values themselves.
    """

    def __init__(self, names: list[str], folds: dict[int, tuple[float, np.ndarray, np.ndarray]], shift: np.ndarray | None = None):
        self.names = names
        self.folds = folds
        self.shift = np.zeros(len(names)) if shift is None else shift

    def merge(self, fold_of) -> "Gram":
        """Add folds up under new numbers: ``fold_of(old) -> new``."""
        out: dict[int, tuple] = {}
        for k, (n, s, g) in self.folds.items():
            a = out.get(fold_of(k), (0.0, 0.0, 0.0))
            out[fold_of(k)] = (a[0] + n, a[1] + s, a[2] + g)
        return Gram(self.names, out, self.shift)

    def without_fold(self, fold: int) -> "Gram":
        return Gram(self.names, {k: v for k, v in self.folds.items() if k != fold}, self.shift)

    def take_folds(self, numbers: dict[int, int]) -> "Gram":
        """The folds ``numbers[new]`` under the numbers ``new``; folds without rows are left out."""
        return Gram(self.names, {new: self.folds[old] for new, old in numbers.items() if old in self.folds}, self.shift)

    def _sums(self, without: int | None = None, only: int | None = None):
        parts = [v for k, v in self.folds.items() if (only is None or k == only) and k != without]
        if not parts:
            q = len(self.names)
            return 0.0, np.zeros(q), np.zeros((q, q))
        return sum(p[0] for p in parts), sum(p[1] for p in parts), sum(p[2] for p in parts)

    def sums(self, without: int | None = None, only: int | None = None):
        """n, sums and cross products of the columns as they are."""
        n, s, g = self._sums(without, only)
        c = self.shift
        return n, s + n * c, g + np.outer(s, c) + np.outer(c, s) + n * np.outer(c, c)

    def pick(self, cols: list[str], y: str) -> "Gram":
        """The same sums for fewer columns; ``y`` becomes the target."""
        at = [self.names.index(c) for c in [*cols, y]]
        return Gram([*cols, y], {k: (n, s[at], g[np.ix_(at, at)]) for k, (n, s, g) in self.folds.items()}, self.shift[at])

    def moments(self, without: int | None = None, only: int | None = None) -> Moments:
        n, s, g = self._sums(without, only)
        c = g - np.outer(s, s) / n
        m = s / n + self.shift
        raw = self.sums(without, only)[2]
        return Moments(n, m[:-1], m[-1], c[:-1, :-1], c[:-1, -1], c[-1, -1], raw[:-1, :-1], raw[:-1, -1])

    def correlation(self) -> np.ndarray:
        """Pearson matrix over all columns; NaN for constant ones."""
        n, s, g = self._sums()
        c = g / n - np.outer(s / n, s / n)
        d = np.diag(c).copy()
        d[d <= 1e-12 * np.maximum(np.diag(g) / n, 1e-300)] = np.nan
        return np.clip(c / np.sqrt(np.outer(d, d)), -1, 1)

    def sse(self, fold: int, coef: np.ndarray, intercept: float) -> float:
        """Squared error of a linear model on one fold, from its sums."""
        n, s, g = self._sums(only=fold)
        b = np.append(-np.asarray(coef, float), 1.0)
        intercept = intercept - float(b @ self.shift)
        return float(b @ g @ b - 2 * intercept * (b @ s) + n * intercept * intercept)


def _pack(q: int):
    return np.triu_indices(q)


#: Merged blocks of at most so many columns go to the driver from all FAN tasks, wider ones are merged once more.
NARROW, FAN = 128, 32


def around(names: list[str], blocks: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Gram:
    """From count, means and centred products per fold: sums around the mean of all."""
    total = sum(n for n, _, _ in blocks.values())
    shift = sum(n * m for n, m, _ in blocks.values()) / total if total else np.zeros(len(names))
    return Gram(names, {k: (n, n * (m - shift), c + n * np.outer(m - shift, m - shift)) for k, (n, m, c) in blocks.items()}, shift)


def _merged(a, b):
    """Two blocks of (count, means, centred products) as one."""
    if a is None:
        return b
    n, off = a[0] + b[0], b[1] - a[1]
    return n, a[1] + off * (b[0] / n), a[2] + b[2] + np.outer(off, off) * (a[0] * b[0] / n)


def _merge_blocks(width: int, batches):
    out = {}
    for batch in batches:
        for fold, v in zip(batch.column("fold").to_pylist(), batch.column("packed").to_pylist()):
            out[fold] = _merged(out.get(fold), _unpacked(v, width))
    if out:
        yield _packed(out, width)


def _packed(blocks: dict, width: int) -> pa.RecordBatch:
    iu = _pack(width)
    rows = [np.concatenate([[n], m, c[iu]]) for n, m, c in blocks.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array(rows, pa.list_(pa.float64()))], ["fold", "packed"])


def _unpacked(v, width: int):
    v = np.asarray(v, float)
    c = np.zeros((width, width))
    c[_pack(width)] = v[1 + width:]
    return float(v[0]), v[1:1 + width].copy(), c + np.triu(c, 1).T


def gram_frame(df: DataFrame, cols: list[str], fold: str | None = None, centred: bool = False) -> DataFrame:
    """(fold, i, j, value): products for i <= j, sums at (-1, j), the count at (-1, -1), all through SQL aggregates;
    ``centred`` gives products around the means, and means. Rows with a NULL are left out."""
    f = F.col(fold).cast("int") if fold else F.lit(0)
    x = [F.col(c).cast("double") for c in cols]
    n = F.sum(F.lit(1.0))
    cells = [(-1, -1, n)]
    cells += [(-1, j, F.avg(x[j]) if centred else F.sum(x[j])) for j in range(len(x))]
    cells += [(i, j, F.covar_pop(x[i], x[j]) * n if centred else F.sum(x[i] * x[j])) for i in range(len(x)) for j in range(i, len(x))]
    flat = df.na.drop(subset=cols).groupBy(f.alias("fold")).agg(*[v.alias(f"v{k}") for k, (_, _, v) in enumerate(cells)])
    return flat.select("fold", F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"v{k}").alias("value"))
        for k, (i, j, _) in enumerate(cells)])).alias("s")).select("fold", "s.*")


def gram(df: DataFrame, cols: list[str], y: str | None = None, fold: str | None = None) -> Gram:
    """Cross products of scalar columns, per fold; rows with a NULL in one of them are left out. ``fold`` may be an array:
    a row counts in each of its folds."""
    names = list(cols) + ([y] if y else [])
    clean = df.na.drop(subset=names)
    array = F.array(*[F.col(c).cast("double") for c in names]).alias("x")
    if len(names) > MAX_FEATURES:
        raise ValueError(f"{len(names)} columns: a p x p matrix of that size does not belong on one machine")
    if len(names) <= SQL_FEATURES and not (fold and isinstance(df.schema[fold].dataType, T.ArrayType)):
        q = len(names)
        folds: dict[int, list] = {}
        for r in gram_frame(df, names, fold, centred=True).collect():
            block = folds.setdefault(r["fold"], [0.0, np.zeros(q), np.zeros((q, q))])
            if r["j"] < 0:
                block[0] = r["value"]
            elif r["i"] < 0:
                block[1][r["j"]] = r["value"]
            else:
                block[2][r["i"], r["j"]] = block[2][r["j"], r["i"]] = r["value"]
        return around(names, {k: tuple(v) for k, v in folds.items()})
    return gram_array(clean.select(array, *([F.col(fold).alias("fold")] if fold else [])),
                      "x", len(names), "fold" if fold else None, names)


def gram_array(df: DataFrame, features: str, width: int, fold: str | None = None,
               names: list[str] | None = None) -> Gram:
    """Cross products of one array column: a matrix product per Arrow batch, one block of count, means and centred
    products per task and fold, blocks merged pair by pair on the executors. Centred blocks lose nothing where a spread
    is small beside the values, and need no look at the data beforehand. NULL arrays, arrays of another width and those
    that hold a NULL are left out. ``fold`` may be an array of one length: a row counts in each of its folds."""
    several = bool(fold) and isinstance(df.schema[fold].dataType, T.ArrayType)
    f = F.col(fold).cast("array<int>" if several else "int") if fold else F.lit(0)
    data = df.select(f.alias("fold"), F.col(features).cast("array<double>").alias("x")).filter(
        F.col("x").isNotNull() & (F.size("x") == width) & F.forall("x", lambda v: v.isNotNull()))

    def blocks(batches):
        acc: dict[int, tuple] = {}
        for b in batches:
            if b.num_rows == 0:
                continue
            x = batch_matrix(b.column("x"), width)
            fo = b.column("fold")
            fo = fo.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1).T if several else [fo.to_numpy(zero_copy_only=False)]
            for mine in fo:
                for k in np.unique(mine):
                    z = x[mine == k]
                    m = z.mean(axis=0)
                    z = z - m
                    acc[int(k)] = _merged(acc.get(int(k)), (float(len(z)), m, z.T @ z))
        if acc:
            yield _packed(acc, width)

    schema = "fold int, packed array<double>"
    parts = data.mapInArrow(blocks, schema).withColumn("__s", F.spark_partition_id() % FAN)
    parts = parts.repartition("fold", "__s").select("fold", "packed").mapInArrow(partial(_merge_blocks, width), schema)
    if width > NARROW:
        parts = parts.repartition("fold").mapInArrow(partial(_merge_blocks, width), schema)
    found: dict[int, tuple] = {}
    for r in parts.collect():
        found[r["fold"]] = _merged(found.get(r["fold"]), _unpacked(r["packed"], width))
    return around(names or [f"x{i}" for i in range(width)], found)


def sum_packed(parts: DataFrame, by: list[str], fan: int = 32) -> DataFrame:
    """Element-wise sum of packed arrays per group: first ``fan`` partial sums per group, then one."""
    vec = parts.select(*by, (F.spark_partition_id() % fan).alias("__s"), array_to_vector("packed").alias("v"))
    first = vec.groupBy(*by, "__s").agg(Summarizer.sum(F.col("v")).alias("v"))
    return first.groupBy(*by).agg(Summarizer.sum(F.col("v")).alias("packed"))


FEW_PARTITIONS = 64


def sum_batches(df: DataFrame, fn, schema_in: list[str], partitions: int | None = None) -> np.ndarray:
    """Total of ``fn(batch) -> 1-d array`` over all Arrow batches of the selected columns.

    An input known to have few ``partitions`` returns its one partial row per partition straight away;
    otherwise the partial rows are added up on the executors."""
    def partial(batches):
        total = None
        for b in batches:
            if b.num_rows:
                v = fn(b)
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["packed"])

    parts = df.select(*schema_in).mapInArrow(partial, "packed array<double>")
    if partitions is not None and partitions <= FEW_PARTITIONS:
        return np.sum([r["packed"] for r in parts.collect()], axis=0)
    row = sum_packed(parts.withColumn("g", F.lit(0)), ["g"]).first()
    return np.asarray(row["packed"].toArray())


def batch_matrix(column, width: int) -> np.ndarray:
    """Rows of an array column; a NULL array or a NULL in one is NaN, an array of another width an error."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    if not column.null_count:
        return flat.reshape(len(column), width)
    out = np.full((len(column), width), np.nan)
    out[~np.asarray(column.is_null())] = flat.reshape(-1, width)
    return out


def correlation_frame(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, r) for every ordered pair; r is NULL where a column is constant."""
    r = gram(df, cols).correlation()
    rows = [(a, b, None if np.isnan(r[i, j]) else float(r[i, j]))
            for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")
