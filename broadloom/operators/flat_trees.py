"""Tree ensembles as flat arrays: one batch kernel scores all trees of all rounds, whatever grew them.

A chained transform per tree costs a plan node and a pass over the vector for each; here a batch of rows walks down all
trees at once, one step per level, and what is wanted of the trees (a sum, a weighted median, the running sums of the
rounds) is taken from the (rows, trees) matrix of leaf values. The arrays travel once per executor.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from broadloom.operators.gram import batch_matrix

#: (row, tree) pairs walked at a time.
PAIRS = 1 << 20
NODE = re.compile(r"^\s*(?:(If) \(feature (\d+) <= (\S+)\)|(Predict): (\S+)|(Else|Tree).*|(If).*)$")


@dataclass
class FlatTrees:
    """Nodes of all trees: a row goes left where its ``feature`` is at most ``threshold``; -1 marks a leaf. NaN goes right."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the node where each row ends."""
        at = np.repeat(self.roots[None], len(x), 0).ravel()
        row = np.repeat(np.arange(len(x)), len(self.roots))
        open_ = np.flatnonzero(self.feature[at] >= 0)
        while len(open_):
            node = at[open_]
            f = self.feature[node]
            at[open_] = np.where(x[row[open_], f] <= self.threshold[node], self.left[node], self.right[node])
            open_ = open_[self.feature[at[open_]] >= 0]
        return at.reshape(len(x), -1)

    def values(self, x: np.ndarray):
        """Blocks of rows as (slice, leaf values)."""
        step = max(1, PAIRS // max(len(self.roots), 1))
        for i in range(0, len(x), step):
            yield slice(i, min(i + step, len(x))), self.value[self.leaves(x[i:i + step])]

    def alike(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that lie on the same side of every threshold as one: the first of each, and which of these every row is."""
        code, span = np.zeros(len(x), np.int64), 0.0
        for f in np.unique(self.feature[self.feature >= 0]):
            cuts = np.unique(self.threshold[self.feature == f])
            span += np.log2(len(cuts) + 1)
            if span >= 62:
                return np.arange(len(x)), np.arange(len(x))
            code = code * (len(cuts) + 1) + np.searchsorted(cuts, x[:, f])
        _, first, place = np.unique(code, return_index=True, return_inverse=True)
        return first, place

    def first(self, trees: int) -> "FlatTrees":
        return replace(self, roots=self.roots[:trees])


def joined(parts: list[FlatTrees]) -> FlatTrees:
    starts = np.cumsum([0] + [len(p.feature) for p in parts])
    shift = lambda name: np.concatenate([np.where(getattr(p, name) < 0, -1, getattr(p, name) + s) for p, s in zip(parts, starts)])
    plain = lambda name: np.concatenate([getattr(p, name) for p in parts])
    return FlatTrees(plain("feature"), plain("threshold"), shift("left"), shift("right"), plain("value"), shift("roots"))


def from_ml(model) -> FlatTrees:
    """The trees of a Spark ML tree, forest or booster, read off its description (one call, numbers in full)."""
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    lines = iter(model.toDebugString.splitlines()[1:])

    def node(line) -> int:
        m, at = NODE.match(line), len(feature)
        if not m or m[7]:
            raise ValueError(f"not a split of a number: {line.strip()}")
        for a in (feature, left, right):
            a.append(-1)
        threshold.append(0.0)
        value.append(0.0)
        if m[4]:
            value[at] = float(m[5])
        else:
            feature[at], threshold[at] = int(m[2]), float(m[3])
            left[at] = node(next(lines))
            next(lines)  # Else
            right[at] = node(next(lines))
        return at

    for line in lines:
        if line.strip() and not line.lstrip().startswith("Tree "):
            roots.append(node(line))
    ints = lambda a: np.array(a, np.int32)
    return FlatTrees(ints(feature), np.array(threshold, float), ints(left), ints(right), np.array(value, float), ints(roots))


def weighted_median(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per row: the smallest value at which the weights of values up to it reach half of all."""
    order = np.argsort(values, axis=1, kind="stable")
    reached = np.cumsum(weights[order], axis=1) >= 0.5 * weights.sum()
    return np.take_along_axis(values, np.take_along_axis(order, reached.argmax(1)[:, None], 1), 1)[:, 0]


@dataclass
class FlatModel:
    """Trees with a weight each, and how they combine: ``sum`` (from ``base``) or ``median``."""
    trees: FlatTrees
    weights: np.ndarray
    cols: list[str]
    base: float = 0.0
    combine: str = "sum"
    info: dict = field(default_factory=dict)

    def transform(self, df: DataFrame, out: str = "pred") -> DataFrame:
        """A row with a NULL in a column takes the right branch there, like NaN."""
        sent = df.sparkSession.sparkContext.broadcast((self.trees, self.weights, self.base, self.combine))
        width = len(self.cols)

        @F.arrow_udf("double")
        def score(x: pa.Array) -> pa.Array:
            trees, weights, base, combine = sent.value
            x = batch_matrix(x, width)
            if combine == "median":  # a row's result is one of the trees' values: rows alike are looked up once
                first, place = trees.alike(x)
                return pa.array(base + np.concatenate([weighted_median(v, weights) for _, v in trees.values(x[first])] or [np.zeros(0)])[place])
            result = np.full(len(x), base)
            for rows, v in trees.values(x):
                result[rows] += v @ weights
            return pa.array(result)

        return df.withColumn(out, score(_features(self.cols)))


def _features(cols):
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in cols])


def _staged(sent, width, batches):
    models, sums = sent.value, {}
    for batch in batches:
        x, y, g = batch_matrix(batch.column("x"), width), batch.column("y").to_numpy(zero_copy_only=False), batch.column("g").to_numpy()
        for group in np.unique(g):
            trees, weights, base = models[group]
            mine = g == group
            yy = y[mine]
            acc = sums.setdefault(int(group), np.zeros((len(weights), 4)))
            acc[:, 0] += len(yy)
            acc[:, 1] += (yy - base).sum()
            acc[:, 2] += ((yy - base) ** 2).sum()
            for rows, v in trees.values(x[mine]):
                acc[:, 3] += ((yy[rows, None] - base - np.cumsum(v * weights, axis=1)) ** 2).sum(0)
    for group, acc in sums.items():
        r = len(acc)
        yield pa.record_batch([pa.array(np.full(r, group, np.int32)), pa.array(np.arange(r, dtype=np.int32)), *[pa.array(c) for c in acc.T]],
                              names=["fold", "round", "n", "s", "q", "e"])


def staged_scores(df: DataFrame, models: dict[int, FlatModel], y: str, group: str = "fold") -> DataFrame:
    """(fold, round, n, r2, rmse): the score of each model's first trees on the rows of its group, after every round.

    One pass whatever the rounds and groups; tasks hand on four sums per group and round. Rows whose group has no model,
    or without a target, are left out. R2 is NULL where the target does not vary.
    """
    cols = next(iter(models.values())).cols
    sent = df.sparkSession.sparkContext.broadcast({g: (m.trees, m.weights, m.base) for g, m in models.items()})
    rows = df.filter(F.col(group).isin(list(models)) & F.col(y).isNotNull()).select(
        _features(cols).alias("x"), F.col(y).cast("double").alias("y"), F.col(group).cast("int").alias("g"))
    sums = rows.mapInArrow(partial(_staged, sent, len(cols)), "fold int, round int, n double, s double, q double, e double")
    sums = sums.groupBy("fold", "round").agg(*[F.sum(c).alias(c) for c in "nsqe"])
    spread = F.col("q") - F.col("s") * F.col("s") / F.col("n")  # around the model's base, which is amid the target
    return sums.select("fold", "round", F.col("n").cast("bigint").alias("n"), (1 - F.try_divide("e", spread)).alias("r2"),
                       F.sqrt(F.col("e") / F.col("n")).alias("rmse"))
