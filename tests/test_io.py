from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from broadloom import session as X
from broadloom.functions import columns as C
from broadloom.operators import encode as E
from broadloom.sources import readers as R, writers as W


def test_prediction_folder(spark, tmp_path):
    long = spark.createDataFrame([(1, "m1", 0.5), (2, "m1", 1.5), (1, "m.2", 2.5), (2, "m.2", 3.5)], "ID bigint, model string, pred double")
    W.write_predictions(long, str(tmp_path / "p"), ["m1", "m.2"])
    wide = R.pivot_predictions(R.read_predictions(spark, str(tmp_path / "p")), ["m1", "m.2"])
    assert sorted(tuple(r) for r in wide.collect()) == [(1, 0.5, 2.5), (2, 1.5, 3.5)]


def test_gate_and_stamp(spark, tmp_path):
    preds = spark.createDataFrame([(1, "good", 1.0), (1, "bad", 2.0)], "ID bigint, model string, pred double")
    scores = spark.createDataFrame([("good", 0.5, 0.6), ("bad", 0.5, 0.3)], "model string, oof_r2 double, infold_r2 double")
    W.write_gated(preds, scores, 0.4, str(tmp_path / "g"))
    assert (tmp_path / "g" / "model=good" / "score=0.500000").exists()
    assert not (tmp_path / "g" / "model=bad").exists()


def test_trial_log_appends(spark, tmp_path):
    for t in (1, 2):
        W.log_trials(spark.createDataFrame([(t, 0.1 * t)], "trial int, metric double"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_nested_json(spark, tmp_path):
    (tmp_path / "q.json").write_text('{"answers": [{"y_value": 1.5, "k": "a"}, {"k": "b"}]}')
    out = R.read_json(spark, str(tmp_path / "q.json"), "answers array<struct<y_value: double, k: string>>", "answers")
    assert [tuple(r) for r in out.collect()] == [(1.5, "a"), (None, "b")]


def test_probe_text(spark):
    df = spark.createDataFrame([("list(y_value = 91.2, NA)",), ("list(y_value = , NA)",), ("NA",), (None,)], "t string")
    assert [r[0] for r in df.select(C.extract_number("t")).collect()] == [91.2, None, None, None]


def test_run_lengths_and_logs(spark):
    df = spark.createDataFrame([(1, 1, 0, 1), (0, 0, 0, 0), (1, 1, 1, 1)], "a int, b int, c int, d int")
    out = E.row_statistics(df, ["a", "b", "c", "d"]).collect()
    assert [r["consec"] for r in out] == [2, 0, 4] and [r["flag_sum"] for r in out] == [3, 0, 4]
    assert out[1]["log_row_means"] is None and out[2]["log_row_means"] == 0.0


def test_formula_zero_divisor(spark):
    df = spark.createDataFrame([(1, 0, 0, 1, -E.MINED_RATIO_BOTTOM)], "a int, b int, c int, t int, d double")
    assert df.select(E.mined_feature(F.lit(0), F.lit(0), ["a", "b", "c"], "t", "d")).first()[0] is None


def test_grid_and_column_picks(spark):
    grid = R.param_grid(spark.range(2), {"z": [1, 2, 3], "j": ["a", "b"]})
    assert grid.count() == 12 and "Cartesian" not in grid._jdf.queryExecution().toString()
    df = spark.createDataFrame([(1, "a", 2.0)], "ID int, code string, x_code double")
    assert C.columns_matching(df, "code") == ["code", "x_code"] and C.columns_matching(df, "code", keep=False) == ["ID"]
    assert C.numeric_columns(df, exclude=("ID",)) == ["x_code"] and C.string_columns(df) == ["code"]
    assert C.other_columns(df, "ID") == ["code", "x_code"]


def test_scratch_follows_the_session(spark, tmp_path, monkeypatch):
    assert X.scratch_dir(spark) == X.scratch_dir(spark)
    conf = lambda value: SimpleNamespace(get=lambda k, d: value if k == "spark.checkpoint.dir" else d)
    assert X.scratch_dir(SimpleNamespace(conf=conf("/shared/x"))) == "/shared/x"
    with pytest.raises(RuntimeError):
        X.scratch_dir(SimpleNamespace(conf=conf(None), sparkContext=SimpleNamespace(master="yarn")))
    monkeypatch.setattr(X, "scratch_dir", lambda s: str(tmp_path))
    df = X.durable(spark.range(5).withColumn("s", F.lit("x")))
    assert df.count() == 5 and any(tmp_path.iterdir())


def test_parallel_jobs_keep_order(spark):
    assert X.side_by_side([lambda i=i: spark.range(i).count() for i in range(6)]) == list(range(6))
