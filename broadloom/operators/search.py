"""Parameter search: grids, resampled tuning, round curves, model comparison."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, functions as F

from broadloom.operators import linear as L, trees as T
from broadloom.operators.evaluate import R2Evaluator
from broadloom.operators.flat_trees import FlatModel, from_ml, joined, staged_scores
from broadloom.operators.gram import Gram
from broadloom.operators.linear import assemble
from broadloom.session import durable, side_by_side

#: Beyond so many rows, forests are grown from sums of equal rows: their fits no longer grow with the rows.
ROWS_BY_ONE = 1_000_000


def pooled_r2(g: Gram, fit) -> float:
    """Out-of-fold R2 of ``fit(moments)`` from fold sums alone."""
    total = g.moments()
    sse = 0.0
    for k in g.folds:
        m = g.moments(without=k)
        coef, b0 = L._with_intercept(m, fit(m))
        sse += g.sse(k, coef, b0)
    return 1.0 - sse / total.syy


def grid_trials(g: Gram, y: str, columns, fit, z_values, j_values, stop_above: float | None = None):
    """Trial per (z, j): ``columns(z, j)`` names the features, ``fit(moments, z, j)`` the coefficients. One pass
    over the rows served them all; the loop ends early once a trial beats ``stop_above``."""
    rows = []
    for trial, (z, j) in enumerate(product(z_values, j_values)):
        r2 = pooled_r2(g.pick(columns(z, j), y), lambda m: fit(m, z, j))
        rows.append((trial, z, j, float(r2)))
        if stop_above is not None and r2 > stop_above:
            break
    return rows


def trial_frame(spark, rows) -> DataFrame:
    return spark.createDataFrame(rows, "trial int, z int, j int, metric double")


def tuned(df: DataFrame, cols, y: str, estimator, grid, fold: str, parallelism: int = 4):
    """CrossValidator on given folds with R2 as the target; fold fits run side by side."""
    data = assemble(df, cols, y).select("features", "label", F.col(fold).cast("int").alias(fold))
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=R2Evaluator(),
                        foldCol=fold, numFolds=data.agg(F.max(fold)).first()[0] + 1, parallelism=parallelism)
    return cv.fit(data)


def tuned_forest(df: DataFrame, cols, y: str, key: str, fold: str, mtry, trees: int = 8, max_depth: int = 5, seed: int = 1,
                 rows_by_one: int = ROWS_BY_ONE) -> list[float]:
    """Mean R2 over the folds of a random forest for each number of columns a node may choose from.

    Up to ``rows_by_one`` rows the forests draw their bags row by row. Beyond, a bag is a Poisson bootstrap by the key, and
    rows equal in columns and fold are one row with its weight and mean target in each bag: one pass serves all fits, which
    read what it leaves, and held-out rows are scored by the sums of equal ones.
    """
    if df.count() <= rows_by_one:
        est = RandomForestRegressor(numTrees=trees, maxDepth=max_depth, seed=seed)
        grid = ParamGridBuilder().addGrid(est.featureSubsetStrategy, list(mtry)).build()
        return [float(v) for v in tuned(df, cols, y, est, grid, fold).avgMetrics]
    return _forests_of_sums(df.na.drop(subset=list(cols)), list(cols), y, key, fold, list(mtry), trees, max_depth, seed)


def _forests_of_sums(df: DataFrame, cols, y, key, fold, mtry, trees, max_depth, seed) -> list[float]:
    sums = T.bag_sums(df, [*cols, fold], y, key, trees, seed)
    target = F.col(y).cast("double")
    n, mean = F.col("__n"), F.col("__mean")
    held = durable(df.groupBy(*cols, fold).agg(F.count(target).alias("__n"), F.avg(target).alias("__mean"), (
        F.var_pop(target) * F.count(target)).alias("__ss")))
    means = {r[0]: r[1] for r in held.groupBy(fold).agg(F.sum(n * mean) / F.sum(n)).collect()}
    folds = sorted(means, key=lambda k: (k is None, k))
    if len(folds) < 2 or folds != list(range(len(folds))):
        raise ValueError(f"folds must be 0, 1, ... without gaps, at least two: {folds}")

    def grown(m, k, b):
        data = T.one_bag(sums, [*cols, fold], b).filter(F.col(fold) != k)
        est = RandomForestRegressor(numTrees=1, bootstrap=False, maxDepth=max_depth, featureSubsetStrategy=m, seed=seed + b, weightCol="w")
        return from_ml(est.fit(assemble(data, cols, "__y").select("features", "label", "w").coalesce(1)))

    def score(m, k, forest):
        scored = FlatModel(joined(forest), np.full(trees, 1 / trees), cols).transform(held.filter(F.col(fold) == k), "__pred")
        sse, sst = scored.agg(F.sum(n * (mean - F.col("__pred")) ** 2 + F.col("__ss")), F.sum(
            n * (mean - F.lit(means[k])) ** 2 + F.col("__ss"))).first()
        return 1 - sse / sst if sst else float("-inf")

    cases = list(product(mtry, folds))
    fitted = side_by_side([lambda c=c, b=b: grown(*c, b) for c in cases for b in range(trees)])
    r2 = side_by_side([lambda i=i, c=c: score(*c, fitted[i * trees:(i + 1) * trees]) for i, c in enumerate(cases)])
    return [float(np.mean(r2[i:i + len(folds)])) for i in range(0, len(r2), len(folds))]


def resampled_trials(grams: dict[int, Gram], grid, make):
    """(config, rep, fold, r2) of every penalty on every resample, from fold sums."""
    rows = []
    for rep, g in grams.items():
        for k in sorted(g.folds):
            m = g.moments(without=k)
            held = g.moments(only=k)
            for c, a in enumerate(grid):
                coef, b0 = L._with_intercept(m, make(a)(m))
                rows.append((c, float(a), rep, k, float(1 - g.sse(k, coef, b0) / held.syy)))
    return rows


def round_curve(df: DataFrame, cols, y: str, fold: str, k: int, rounds: int, **params) -> DataFrame:
    """(fold, round, n, r2, rmse) of boosting fitted on the other folds: fits side by side, one scoring pass for all."""
    models = side_by_side([lambda f=f: T.flat_boosted(T.boosted(df.filter(F.col(fold) != f), cols, y, rounds=rounds, **params)) for f in range(k)])
    return staged_scores(df, dict(enumerate(models)), y, fold)


def compare_models(scores: DataFrame, models: list[str], by: str = "fold", value: str = "r2") -> DataFrame:
    """One row per resample, one metric column per model."""
    return scores.groupBy(by).pivot("model", models).agg(F.first(value))
