"""Table writers, the quality gate and the trial log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from broadloom.session import new_path, side_by_side


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_table(df: DataFrame, path: str, partition_by=()) -> None:
    writer = df.write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_predictions(long: DataFrame, path: str, models: list[str], key: str = "ID") -> None:
    """One ``<model>.csv`` table per model. The predictions are computed once and split by model on disk."""
    stage = new_path(long.sparkSession, "predictions")
    long.select(key, "model", "pred").write.partitionBy("model").parquet(stage)
    split = long.sparkSession.read.schema(f"{key} bigint, pred double, model string").parquet(stage)
    side_by_side([lambda m=m: write_csv(split.filter(F.col("model") == m).select(key, "pred"), f"{path}/{m}.csv")
                  for m in models])


def gate(predictions: DataFrame, metrics: DataFrame, threshold: float,
         scores=("oof_r2", "infold_r2")) -> DataFrame:
    """Predictions of those models whose scores all exceed the threshold."""
    ok = metrics
    for s in scores:
        ok = ok.filter(F.col(s) > threshold)
    return predictions.join(F.broadcast(ok.select("model")), "model", "left_semi")


def write_gated(predictions: DataFrame, metrics: DataFrame, threshold: float, path: str,
                scores=("oof_r2", "infold_r2")) -> None:
    """Write what passes the gate, in folders stamped with model and score."""
    stamp = metrics.select("model", F.format_string("%.6f", scores[0]).alias("score"))
    out = gate(predictions, metrics, threshold, scores).join(F.broadcast(stamp), "model")
    out.write.partitionBy("model", "score").option("header", True).csv(path)


def log_trials(trials: DataFrame, path: str) -> None:
    trials.write.mode("append").parquet(path)
