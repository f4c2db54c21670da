"""Folds, holdouts, resamples, trial logs, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from broadloom.operators import evaluate as V, sampling as S
from broadloom.operators.ordering import contiguous_folds
from broadloom.plans.fixtures import table, wide, with_wide
from broadloom.plans.q_relational import MODELS, PREDS_WIDE_CTE, predictions_long
from broadloom.plans.registry import query
from broadloom.session import new_path
from broadloom.sources import readers as R, writers as Wr


def orders_xy(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("ID"), F.col("o_totalprice").alias("y"))


def h52(key: str, seed: int) -> str:
    return f"('0x' || substr(md5({key} || '|{seed}'), 1, 13))::BIGINT"


@query("WIN-3 SMP-5", "SELECT o_orderkey AS ID, CAST(ntile(5) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS fold FROM orders")
def kfold_contig(spark, sf):
    return contiguous_folds(orders_xy(spark, sf), "ID", 5).select("ID", "fold")


@query("WIN-4 SMP-5", """SELECT o_orderkey AS ID, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) % 5 AS INTEGER) AS by_position,
    CAST(o_orderkey % 5 AS INTEGER) AS by_key FROM orders""")
def kfold_modulo(spark, sf):
    df = S.modulo_folds(orders_xy(spark, sf), "ID", 5, "by_position", by_position=True)
    return S.modulo_folds(df, "ID", 5, "by_key").select("ID", "by_position", "by_key")


@query("SMP-1", f"SELECT o_orderkey AS ID, {h52('o_orderkey', 0)} < {int(round(0.2 * (1 << 52)))} AS holdout FROM orders")
def holdout_hash(spark, sf):
    return S.holdout(orders_xy(spark, sf), "ID", 0.2, 0).select("ID", "holdout")


@query("SMP-2", with_wide(f"""SELECT 5::BIGINT AS seeds, round(avg(r2), 6) AS mean_r2, sum(n)::BIGINT AS n FROM (
    SELECT seed, count(*) AS n, 1 - sum((y_lin - line) * (y_lin - line)) / (var_pop(y_lin) * count(*)) AS r2 FROM (
      SELECT ID, y_lin, (SELECT regr_intercept(y_lin, X22) FROM wide) + (SELECT regr_slope(y_lin, X22) FROM wide) * X22 AS line FROM wide),
      (SELECT unnest([0, 1, 2, 3, 4]) AS seed)
    WHERE ('0x' || substr(md5(ID || '|' || seed), 1, 13))::BIGINT < {int(round(0.2 * (1 << 52)))} GROUP BY seed)"""))
def multi_seed_metric(spark, sf):
    df = wide(spark, sf, "ID", "X22", "y_lin")
    line = df.agg(F.regr_slope("y_lin", "X22").alias("b"), F.regr_intercept("y_lin", "X22").alias("a")).first()
    df = df.withColumn("pred", F.lit(line["a"]) + F.lit(line["b"]) * F.col("X22"))
    per = V.regression_metrics(S.seeded_holdouts(df, "ID", 0.2, range(5)), "y_lin", "pred", by=("seed",))
    return per.agg(F.count("seed").alias("seeds"), F.round(F.avg("r2"), 6).alias("mean_r2"), F.sum("n").alias("n"))


@query("SMP-4", with_wide(f"""SELECT d.ID AS draw, p.ID FROM dr d JOIN pool p ON p.X4 = d.X4 AND p.idx = d.idx
    UNION ALL SELECT NULL, ID FROM (SELECT ID FROM wide WHERE tc = 1 ORDER BY {h52('ID', 9)}, ID
      LIMIT (SELECT count(*) FROM wide WHERE tc = 0 AND X4 NOT IN (SELECT X4 FROM wide WHERE tc = 1)))""",
    f"""pool AS (SELECT ID, X4, row_number() OVER (PARTITION BY X4 ORDER BY {h52('ID', 7)}, ID) - 1 AS idx FROM wide WHERE tc = 1),
    dr AS (SELECT w.ID, w.X4, {h52('w.ID', 8)} % n AS idx FROM wide w JOIN (SELECT X4, count(*) AS n FROM wide WHERE tc = 1 GROUP BY X4) s
      ON s.X4 = w.X4 WHERE tc = 0)"""))
def strat_resample(spark, sf):
    df = wide(spark, sf, "ID", "tc", "X4")
    out = S.stratified_resample(df.filter("tc = 1").drop("tc"), df.filter("tc = 0").drop("tc"), "X4", "ID", 7)
    return out.select("draw", "ID")


EDGES = "+".join(f" CAST(y > (SELECT quantile_cont(y, {q}) FROM src) AS INTEGER) " for q in (0.2, 0.4, 0.6, 0.8))


@query("SMP-6", f"""WITH src AS (SELECT o_orderkey AS ID, o_totalprice AS y FROM orders),
    b AS (SELECT ID, y, {EDGES} AS bin FROM src)
    SELECT ID, bin, CAST((row_number() OVER (PARTITION BY bin ORDER BY {h52('ID', 4)}, ID) - 1) % 5 AS INTEGER) AS fold_1,
    CAST((row_number() OVER (PARTITION BY bin ORDER BY {h52('ID', 5)}, ID) - 1) % 5 AS INTEGER) AS fold_2 FROM b""")
def strat_folds(spark, sf):
    return S.stratified_folds(orders_xy(spark, sf), "ID", "y", 5, 2, 3).select("ID", "bin", "fold_1", "fold_2")


POISSON_STEPS = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563,
                 0.9994058151824183, 0.999916758850712, 0.9999898033746081, 0.9999988747974664]


@query("SMP-8", "SELECT bag, count(*) AS n, round(sum(w), 4)::DOUBLE AS drawn, round(sum(w * y) / sum(w), 4) AS bag_mean FROM ("
       "SELECT bag, y, " + " + ".join(
           f"CAST(h >= {int(c * (1 << 52))} AS INTEGER)" for c in POISSON_STEPS) + " AS w FROM ("
       "SELECT bag, o_totalprice AS y, ('0x' || substr(md5(o_orderkey || '|' || bag), 1, 13))::BIGINT AS h "
       "FROM orders, (SELECT unnest([0, 1, 2]) AS bag))) WHERE w > 0 GROUP BY bag")
def bootstrap_bags(spark, sf):
    df = orders_xy(spark, sf)
    bags = S.with_poisson_weight(df.withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(2)))), "ID", F.col("bag"))
    return bags.filter("w > 0").groupBy("bag").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 4).alias("drawn"),
        F.round(F.sum(F.col("w") * F.col("y")) / F.sum("w"), 4).alias("bag_mean"))


# ---- trial logs: one trial per customer, one learning curve per key residue -----------------------------------

TRIALS_SQL = """trials AS (SELECT o_custkey AS trial, o_custkey % 8 AS z, o_custkey // 8 AS j,
    sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT / (count(*) * 50000000.0::DOUBLE) AS metric FROM orders GROUP BY o_custkey)"""
ROUNDS_SQL = """rounds AS (SELECT CAST(o_orderkey % 5 AS INTEGER) AS fold, CAST(o_orderkey // 5 % 40 AS INTEGER) AS round,
    round(avg(o_totalprice) / 1000, 4) AS rmse FROM orders GROUP BY 1, 2)"""


def trials(spark, sf) -> DataFrame:
    t = F.col("o_custkey")
    return table(spark, sf, "orders").groupBy(t.alias("trial")).agg(
        (F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")) / (F.count(F.lit(1)) * F.lit(50000000.0))).alias("metric")).select(
        "trial", (F.col("trial") % 8).alias("z"), F.expr("trial div 8").alias("j"), "metric")


def rounds(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").groupBy(
        (F.col("o_orderkey") % 5).cast("int").alias("fold"), F.expr("cast(o_orderkey div 5 % 40 as int)").alias("round")).agg(
        F.round(F.avg("o_totalprice") / 1000, 4).alias("rmse"))


@query("WIN-6 ORD-3 SNK-5", "WITH " + TRIALS_SQL + """ SELECT (SELECT min(trial) FROM trials WHERE metric > 0.3111) AS first_trial,
    (SELECT arg_min(metric, trial) FROM trials WHERE metric > 0.3111) AS first_metric, (SELECT max(metric) FROM trials) AS best_metric,
    (SELECT trial FROM trials ORDER BY metric DESC, trial LIMIT 1) AS best_trial, (SELECT min(metric) FROM trials) AS worst_metric""")
def trial_best(spark, sf):
    path = new_path(spark, "trials")
    log = trials(spark, sf)
    Wr.log_trials(log.filter("z < 4"), path)
    Wr.log_trials(log.filter("z >= 4"), path)
    return V.first_beating(R.read_table(spark, path), "trial", "metric", 0.3111)


@query("WIN-5 WIN-6", "WITH " + TRIALS_SQL + """ SELECT trial, z, j, metric,
    round(avg(metric) OVER (ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 8) AS mean_so_far,
    max(metric) OVER (ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_so_far FROM trials""")
def running_score(spark, sf):
    return V.running_score(trials(spark, sf), "trial", "metric").withColumn("mean_so_far", F.round("mean_so_far", 8))


@query("WIN-7 EVL-7", "WITH " + ROUNDS_SQL + """, best AS (SELECT fold, round, rmse,
      min(rmse) OVER w AS b, arg_min(round, rmse) OVER w AS br FROM rounds WINDOW w AS (PARTITION BY fold ORDER BY round)),
    stop AS (SELECT fold, coalesce(min(CASE WHEN round - br >= 8 THEN round END), max(round)) AS stop_round FROM best GROUP BY fold)
    SELECT s.fold, stop_round, br AS best_round, b AS best_metric FROM stop s JOIN best ON best.fold = s.fold AND best.round = s.stop_round""")
def early_stop_round(spark, sf):
    return V.early_stop(rounds(spark, sf), "rmse", 8)


@query("EVL-7", "WITH " + ROUNDS_SQL + """ SELECT round, round(avg(rmse), 6) AS mean_rmse, round(stddev_samp(rmse), 6) AS sd_rmse
    FROM rounds GROUP BY round""")
def round_average(spark, sf):
    return rounds(spark, sf).groupBy("round").agg(
        F.round(F.avg("rmse"), 6).alias("mean_rmse"), F.round(F.stddev_samp("rmse"), 6).alias("sd_rmse"))


# ---- metrics -------------------------------------------------------------------------------------------------

LINE = """line AS (SELECT regr_slope(y_lin, X22) AS b, regr_intercept(y_lin, X22) AS a FROM wide),
scored AS (SELECT ID, X0, y_lin AS y, a + b * X22 AS pred, CAST(ID % 5 AS INTEGER) AS fold FROM wide, line)"""


def line_scored(spark, sf) -> DataFrame:
    df = wide(spark, sf, "ID", "X22", "y_lin")
    line = df.agg(F.regr_slope("y_lin", "X22").alias("b"), F.regr_intercept("y_lin", "X22").alias("a")).first()
    return df.select("ID", F.col("y_lin").alias("y"), (F.lit(line["a"]) + F.lit(line["b"]) * F.col("X22")).alias("pred"),
                     (F.col("ID") % 5).cast("int").alias("fold"))


@query("EVL-1 EVL-3 EVL-4 UDF-1 UDF-3", with_wide("""SELECT count(*) AS n, round(1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)), 6) AS r2,
    round(pow(corr(y, pred), 2), 6) AS cor2, round(sqrt(avg((y - pred) * (y - pred))), 6) AS rmse, round(avg(abs(y - pred)), 6) AS mae FROM scored""", LINE))
def r2_rmse_mae(spark, sf):
    m = V.regression_metrics(line_scored(spark, sf), "y", "pred")
    return m.select("n", *[F.round(c, 6).alias(c) for c in ("r2", "cor2", "rmse", "mae")])


@query("EVL-2 UDF-3", with_wide("""SELECT round(sse, 4) AS sse, round(sst, 4) AS sst, round(1 - sse / sst, 6) AS r2,
    round(1 - (sse / sst) * (n - 1) / (n - 2), 6) AS adj_r2
    FROM (SELECT count(*) AS n, sum((y - pred) * (y - pred)) AS sse, var_pop(y) * count(*) AS sst FROM scored)""", LINE))
def adj_r2(spark, sf):
    m = V.regression_metrics(line_scored(spark, sf), "y", "pred", p=1)
    return m.select(F.round("sse", 4).alias("sse"), F.round("sst", 4).alias("sst"), F.round("r2", 6).alias("r2"),
                    F.round("adj_r2", 6).alias("adj_r2"))


@query("EVL-5", with_wide("""SELECT round(avg(r2), 6) AS fold_r2, (SELECT round(1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)), 6) FROM scored) AS oof_r2,
    (SELECT count(*) FROM scored) AS n
    FROM (SELECT fold, 1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)) AS r2 FROM scored GROUP BY fold)""", LINE))
def fold_metrics(spark, sf):
    return V.fold_report(line_scored(spark, sf), "y", "pred").select(
        F.round("fold_r2", 6).alias("fold_r2"), F.round("oof_r2", 6).alias("oof_r2"), "n")


@query("EVL-8", with_wide("""SELECT fold, round(max(CASE WHEN model = 'mean_X0' THEN r2 END), 6) AS "mean_X0",
    round(max(CASE WHEN model = 'mean_X1' THEN r2 END), 6) AS "mean_X1", round(max(CASE WHEN model = 'line_X22' THEN r2 END), 6) AS "line_X22" FROM (
      SELECT CAST(ID % 5 AS INTEGER) AS fold, model, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2 FROM (
        SELECT ID, y, 'mean_X0' AS model, mean_X0 AS p FROM preds UNION ALL SELECT ID, y, 'mean_X1', mean_X1 FROM preds
        UNION ALL SELECT ID, y, 'line_X22', line_X22 FROM preds) GROUP BY ALL) GROUP BY fold""", PREDS_WIDE_CTE))
def model_compare(spark, sf):
    from broadloom.operators.search import compare_models

    df = wide(spark, sf, "ID", "y", "X0", "X1", "X22")
    long = predictions_long(df, "y").withColumn("fold", (F.col("ID") % 5).cast("int"))
    scores = V.regression_metrics(long, "y", "pred", by=("fold", "model")).select("fold", "model", F.round("r2", 6).alias("r2"))
    return compare_models(scores, MODELS)
