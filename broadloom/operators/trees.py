"""Tree ensembles on Spark ML, adaptive boosting, bagging and isolation scores."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from broadloom.operators import grower
from broadloom.operators.flat_trees import FlatModel, from_ml, joined, staged_scores
from broadloom.operators.gram import batch_matrix
from broadloom.operators.linear import assemble
from broadloom.operators.ordering import exact_quantiles
from broadloom.operators.sampling import with_poisson_weight
from broadloom.session import durable, side_by_side


@dataclass
class TreeModel:
    """A fitted Spark ML regressor, its input columns and the constant taken off the target."""
    model: object
    cols: list[str]
    base: float = 0.0
    info: dict = field(default_factory=dict)

    def transform(self, df: DataFrame, out: str = "pred") -> DataFrame:
        return predict_many([self], df, [out])

    def importances(self, spark) -> DataFrame:
        v = self.model.featureImportances.toArray()
        return spark.createDataFrame([(c, float(x)) for c, x in zip(self.cols, v)], "feature string, importance double")


def predict_many(models: list[TreeModel], df: DataFrame, names: list[str]) -> DataFrame:
    """One prediction column per model, over one assembled vector."""
    out = VectorAssembler(inputCols=models[0].cols, outputCol="__features", handleInvalid="keep").transform(df)
    for m, name in zip(models, names):
        out = m.model.copy().setFeaturesCol("__features").setPredictionCol(name).transform(out)
    return out.withColumns({n: F.col(n) + F.lit(m.base) for m, n in zip(models, names) if m.base}).drop("__features")


def tree(df, cols, y, max_depth: int = 5, weight: str | None = None, seed: int = 1) -> TreeModel:
    data = assemble(df, cols, y)
    est = DecisionTreeRegressor(maxDepth=max_depth, seed=seed)
    if weight:
        est.setWeightCol(weight)
    return TreeModel(est.fit(data), list(cols))


def forest(df, cols, y, trees: int = 50, max_depth: int = 8, mtry: str = "onethird", bootstrap: bool = True,
           subsample: float = 1.0, seed: int = 1) -> TreeModel:
    """Random forest. Without bootstrap it stands in for extra trees: splits are the best ones of a random
    column subset, not random thresholds."""
    est = RandomForestRegressor(numTrees=trees, maxDepth=max_depth, featureSubsetStrategy=mtry,
                                bootstrap=bootstrap, subsamplingRate=subsample, seed=seed)
    return TreeModel(est.fit(assemble(df, cols, y)), list(cols))


def boosted(df, cols, y, rounds: int = 50, step: float = 0.1, max_depth: int = 4, subsample: float = 1.0,
            loss: str = "squared", validation: str | None = None, tol: float = 0.01, seed: int = 1) -> TreeModel:
    """Gradient boosting from the target mean; with a boolean validation column it stops early on its loss."""
    data = assemble(df, cols, y)
    base = data.agg(F.avg("label")).first()[0]
    data = data.withColumn("label", F.col("label") - F.lit(base))
    stop = {"validationIndicatorCol": validation, "validationTol": tol} if validation else {}
    est = GBTRegressor(maxIter=rounds, stepSize=step, maxDepth=max_depth, subsamplingRate=subsample, lossType=loss,
                       seed=seed, **stop)
    model = est.fit(data)
    return TreeModel(model, list(cols), base, {"rounds": model.getNumTrees})


def flat_boosted(model: TreeModel) -> FlatModel:
    """A fitted booster as flat trees, each round one of them."""
    return FlatModel(from_ml(model.model), np.array(model.model.treeWeights), model.cols, model.base)


def boosting_curve(model: TreeModel, df: DataFrame, y: str) -> list[float]:
    """Validation RMSE after each round."""
    scored = staged_scores(df.withColumn("__all", F.lit(0)), {0: flat_boosted(model)}, y, "__all")
    return [r.rmse for r in sorted(scored.collect(), key=lambda r: r.round)]


# ---- adaptive boosting -------------------------------------------------------------------------------------

@dataclass
class AdaBoostModel:
    models: list[FlatModel]
    weights: list[float]

    def flat(self) -> FlatModel:
        return FlatModel(joined([m.trees for m in self.models]), np.array(self.weights), self.models[0].cols, combine="median")

    def transform(self, df: DataFrame, out: str = "pred") -> DataFrame:
        """Weighted median of the trees, one kernel for all of them."""
        return self.flat().transform(df, out)


def adaboost_r2(df, cols, y, key: str, rounds: int = 300, learning_rate: float = 0.01, max_depth: int = 5,
                seed: int = 1337, cut_every: int = 25) -> AdaBoostModel:
    """AdaBoost.R2 with linear loss and weighted tree fits, between at most 64 bins a column. Rows equal in bins and target
    have the same weight in every round: they are one row with their number as first weight. Up to ROWS_IN_TASK of these
    all rounds are one task; beyond, a round is two passes or, where bins meet in very many combinations, one per level and
    one more, and the row weights are written to the scratch folder every ``cut_every`` rounds. Nothing is drawn: ``seed``
    and ``key`` do not matter."""
    cols = list(cols)
    bins = grower.find_bins(df, cols)
    trees, weights = grower.boost_r2(durable(grower.counted(df, bins, y)), bins, rounds, learning_rate, max_depth, cut_every)
    return AdaBoostModel([FlatModel(t, np.ones(1), cols) for t in trees], weights)


@dataclass
class BaggedModel:
    models: list[TreeModel]

    def transform(self, df: DataFrame, out: str = "pred") -> DataFrame:
        share = np.full(len(self.models), 1 / len(self.models))
        return FlatModel(joined([from_ml(m.model) for m in self.models]), share, self.models[0].cols).transform(df, out)


def bag_sums(df, cols, y, key: str, bags: int, seed: int) -> DataFrame:
    """__x0, __x1, ... (the columns), and per bag __w<b>, __s<b>: weight and weighted target of the rows equal in
    columns, by Poisson bootstrap weights that depend on the key only. Splits and leaves ask for no more, so all bags take
    one pass over the rows and fits read what this leaves of them."""
    target = F.coalesce(F.col(y).cast("double"), F.lit(float("nan")))  # a missing target stays an error of the fit
    data = df.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__x{i}") for i, c in enumerate(cols)], target.alias("__y"))
    for b in range(bags):
        data = with_poisson_weight(data, "__key", b, seed, f"__w{b}")
    in_bag = lambda b: F.when(F.col(f"__w{b}") > 0, F.col(f"__w{b}") * F.col("__y"))
    return durable(data.groupBy(*[f"__x{i}" for i in range(len(cols))]).agg(
        *[F.sum(f"__w{b}").alias(f"__w{b}") for b in range(bags)], *[F.sum(in_bag(b)).alias(f"__s{b}") for b in range(bags)]))


def one_bag(sums: DataFrame, cols, b: int) -> DataFrame:
    """The columns under their names, the mean target ``__y`` and the weight ``w`` of a bag."""
    return sums.filter(F.col(f"__w{b}") > 0).select(
        *[F.col(f"__x{i}").alias(c) for i, c in enumerate(cols)], (F.col(f"__s{b}") / F.col(f"__w{b}")).alias("__y"), F.col(f"__w{b}").alias("w"))


def bagged_trees(df, cols, y, key: str, bags: int = 10, max_depth: int = 4, seed: int = 1) -> BaggedModel:
    """Trees on Poisson bootstrap weights that depend on the key only, grown from one pass over the rows."""
    cols = list(cols)
    sums = bag_sums(df, cols, y, key, bags, seed)
    return BaggedModel(side_by_side([
        lambda b=b: tree(one_bag(sums, cols, b), cols, "__y", max_depth, weight="w", seed=seed + b) for b in range(bags)]))


# ---- isolation forest ---------------------------------------------------------------------------------------

def _average_path(n: int) -> float:
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, rng, limit: int):
    """Arrays (feature, threshold, left, right, path length at leaves) of one isolation tree."""
    feature, threshold, left, right, depth_at = [], [], [], [], []

    def node(rows: np.ndarray, depth: int) -> int:
        at = len(feature)
        for a in (feature, left, right):
            a.append(-1)
        threshold.append(0.0)
        depth_at.append(depth + _average_path(len(rows)))
        spread = x[rows].max(axis=0) - x[rows].min(axis=0)
        open_cols = np.flatnonzero(spread > 0)
        if depth >= limit or len(rows) <= 1 or not len(open_cols):
            return at
        f = int(rng.choice(open_cols))
        lo = x[rows, f].min()
        t = float(lo + rng.random() * spread[f])
        small = x[rows, f] <= t
        feature[at], threshold[at] = f, t
        left[at] = node(rows[small], depth + 1)
        right[at] = node(rows[~small], depth + 1)
        return at

    node(np.arange(len(x)), 0)
    return feature, threshold, left, right, depth_at


@dataclass
class IsolationModel:
    forest: list[tuple]
    cols: list[str]
    psi: int

    def transform(self, df: DataFrame, out: str = "score") -> DataFrame:
        trees = [tuple(np.asarray(a) for a in t) for t in self.forest]
        norm = max(_average_path(self.psi), 1e-12)
        width = len(self.cols)

        @F.arrow_udf("double")
        def score(x: pa.Array) -> pa.Array:
            m = batch_matrix(x, width)
            total = np.zeros(len(m))
            for f, t, l, r, d in trees:
                at = np.zeros(len(m), dtype=np.int64)
                while True:
                    inner = np.flatnonzero(f[at] >= 0)
                    if not len(inner):
                        break
                    a = at[inner]
                    at[inner] = np.where(m[inner, f[a]] <= t[a], l[a], r[a])
                total += d[at]
            return pa.array(np.power(2.0, -total / len(trees) / norm))

        return df.withColumn(out, score(F.array(*[F.col(c).cast("double") for c in self.cols])))


def isolation_forest(df: DataFrame, cols, key: str, trees: int = 100, sample: int = 256, seed: int = 0) -> IsolationModel:
    """Each tree is grown from ``sample`` rows (the method's own size, a parameter) picked by hash, so a group handed to Python is small
    whatever the table size; the grown forest is a few thousand nodes."""
    data = df.select(key, *cols).na.drop()
    n = data.count()
    psi = min(sample, n)
    frac = min(1.0, (sample + 6 * math.sqrt(sample)) / max(n, 1))
    span = 1 << 40
    h = lambda t: F.pmod(F.xxhash64(F.col(key), t, F.lit(seed)), F.lit(span))
    # Every tree draws by its own hash of the key, whatever the size of the table.
    picked = data.withColumn("__t", F.explode(F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: h(t) < F.lit(int(frac * span)))))
    picked = picked.withColumn("__h", h(F.col("__t")))
    names = list(cols)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["__t"].iloc[0])
        part = pdf.sort_values(["__h", key]).head(psi)
        rng = np.random.default_rng([seed, t])
        limit = max(1, math.ceil(math.log2(max(psi, 2))))
        f, th, l, r, d = _grow(part[names].to_numpy(float), rng, limit)
        return pd.DataFrame({"t": [t], "m": [len(part)], "f": [f], "th": [th], "l": [l], "r": [r], "d": [d]})

    grown = picked.groupBy("__t").applyInPandas(
        build, "t int, m int, f array<int>, th array<double>, l array<int>, r array<int>, d array<double>")
    rows = sorted(grown.collect(), key=lambda r: r["t"])
    return IsolationModel([(r["f"], r["th"], r["l"], r["r"], r["d"]) for r in rows], names, max((r["m"] for r in rows), default=psi))


def outlier_flags(model: IsolationModel, df: DataFrame, contamination: float = 0.1) -> DataFrame:
    """Score and -1 / 1 label; the cut is the exact (1 - contamination) quantile of the scores."""
    scored = durable(model.transform(df, "score"))
    cut = exact_quantiles(scored, {"score": [1 - contamination]})["score"][1 - contamination]
    return scored.withColumn("flag", F.when(F.col("score") > F.lit(cut), -1).otherwise(1))

