"""Metrics, trial logs and early stopping as aggregates."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol
from pyspark.sql import DataFrame, Window as W, functions as F

from broadloom.operators.ordering import running


def regression_metrics(df: DataFrame, label: str = "label", pred: str = "pred", by=(), p: int | None = None) -> DataFrame:
    """n, SSE, SST, R2, squared correlation, RMSE, MAE (and adjusted R2) per group, in one aggregate."""
    y, f = F.col(label).cast("double"), F.col(pred).cast("double")
    out = df.filter(y.isNotNull() & f.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((y - f) * (y - f)).alias("sse"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("sst"),
        F.try_divide(F.pow(F.covar_pop(y, f), 2), F.var_pop(y) * F.var_pop(f)).alias("cor2"),
        F.avg(F.abs(y - f)).alias("mae"))
    out = out.withColumns({"r2": 1 - F.try_divide("sse", "sst"), "rmse": F.sqrt(F.try_divide("sse", "n"))})
    if p is not None:
        out = out.withColumn("adj_r2", 1 - F.try_divide((1 - F.col("r2")) * (F.col("n") - 1), F.col("n") - p - 1))
    return out


def fold_report(df: DataFrame, label: str, pred: str, fold: str = "fold", by=()) -> DataFrame:
    """Mean of the per-fold R2 beside the pooled R2; one pass, since fold sums add up to the pooled ones."""
    y, f = F.col(label).cast("double"), F.col(pred).cast("double")
    per = df.groupBy(*by, fold).agg(
        F.count(F.lit(1)).alias("n"), F.sum((y - f) * (y - f)).alias("sse"),
        F.avg(y).alias("m"), F.var_pop(y).alias("v"))
    per = per.withColumn("r2", 1 - F.try_divide(F.col("sse"), F.col("v") * F.col("n")))
    total = F.sum("n")
    mean = F.sum(F.col("n") * F.col("m")) / total
    sst = F.sum(F.col("n") * (F.col("v") + F.col("m") * F.col("m"))) - total * mean * mean
    return per.groupBy(*by).agg(F.avg("r2").alias("fold_r2"), (1 - F.try_divide(F.sum("sse"), sst)).alias("oof_r2"),
                                total.alias("n"))


class R2Evaluator(Evaluator, HasLabelCol, HasPredictionCol):
    """Custom metric for the tuning loop: R2 of (label, prediction), larger is better."""

    @keyword_only
    def __init__(self, *, labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _evaluate(self, dataset: DataFrame) -> float:
        row = regression_metrics(dataset, self.getLabelCol(), self.getPredictionCol()).first()
        return float(row["r2"]) if row["r2"] is not None else float("-inf")

    def isLargerBetter(self) -> bool:
        return True


def first_beating(trials: DataFrame, trial: str, metric: str, threshold: float) -> DataFrame:
    """First trial above the threshold beside the best one; an aggregate, not an ordered scan."""
    over = F.when(F.col(metric) > threshold, F.col(trial))
    return trials.agg(
        F.min(over).alias("first_trial"),
        F.min_by(metric, over).alias("first_metric"),
        F.max(metric).alias("best_metric"),
        F.max_by(trial, F.struct(F.col(metric), -F.col(trial))).alias("best_trial"),
        F.min(metric).alias("worst_metric"))


def running_score(trials: DataFrame, trial: str, metric: str, **kw) -> DataFrame:
    """Mean so far and best so far after each trial."""
    return running(trials, trial, metric, **kw).select(
        *trials.columns, F.col("run_mean").alias("mean_so_far"), F.col("run_max").alias("best_so_far"))


def early_stop(rounds: DataFrame, metric: str, patience: int, by=("fold",), round_col: str = "round",
               maximize: bool = False) -> DataFrame:
    """Best round when training stops after ``patience`` rounds without a strict improvement.

    The window spans the rounds of one curve, which the round limit of the fit bounds.
    """
    score = -F.col(metric) if maximize else F.col(metric)
    w = W.partitionBy(*by).orderBy(round_col).rowsBetween(W.unboundedPreceding, 0)
    curve = rounds.withColumn("__b", F.min(F.struct(score.alias("s"), F.col(round_col).alias("r"))).over(w))
    stalled = F.col(round_col) - F.col("__b.r") >= patience
    agg = curve.groupBy(*by).agg(
        F.coalesce(F.min(F.when(stalled, F.col(round_col))), F.max(round_col)).alias("stop_round"),
        F.coalesce(F.min_by("__b", F.when(stalled, F.col(round_col))), F.max_by("__b", round_col)).alias("__b"))
    value = -F.col("__b.s") if maximize else F.col("__b.s")
    return agg.select(*by, "stop_round", F.col("__b.r").alias("best_round"), value.alias("best_metric"))


def one_se_choice(trials: DataFrame, config: str, metric: str, complexity: str) -> DataFrame:
    """Simplest configuration within one standard error of the best mean (larger is better)."""
    per = trials.groupBy(config).agg(
        F.avg(metric).alias("mean_metric"), F.first(complexity).alias("complexity"),
        (F.stddev_samp(metric) / F.sqrt(F.count(metric))).alias("se"))
    best = per.agg(F.max_by(F.struct("mean_metric", "se"), "mean_metric").alias("b")).first()["b"]
    if best is None:
        return per.select(config, "complexity", "mean_metric", "se").limit(0)
    ok = per.filter(F.col("mean_metric") >= F.lit(best["mean_metric"] - (best["se"] or 0.0)))
    return ok.orderBy("complexity", F.desc("mean_metric"), config).limit(1).select(
        config, "complexity", "mean_metric", "se")
