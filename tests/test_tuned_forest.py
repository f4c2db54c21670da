import numpy as np
import pytest
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from broadloom.operators import search as H, trees as T
from broadloom.operators.evaluate import R2Evaluator
from broadloom.operators.linear import assemble
from broadloom.operators.sampling import with_poisson_weight

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(3)
    x = r.integers(0, [2, 2, 7], (600, 3))
    y = 3.0 * x[:, 0] - x[:, 1] + x[:, 2] ** 2 + r.normal(size=600)
    data = [(i, int(i % 3), *map(int, v), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame([*data, (600, 0, None, 1, 2, 5.0)], "id int, fold int, a int, b int, c int, y double").cache()


def test_forests_of_sums_are_forests_of_the_drawn_rows(spark, rows):
    got, = H.tuned_forest(rows, COLS, "y", "id", "fold", ["all"], trees=3, max_depth=4, seed=7, rows_by_one=0)
    whole, want = rows.na.drop(), []
    for k in range(3):
        held = assemble(whole.filter(F.col("fold") == k), COLS, "y")
        for b in range(3):
            drawn = with_poisson_weight(whole.filter(F.col("fold") != k), "id", b, 7, "w").filter("w > 0")
            drawn = drawn.withColumn("i", F.explode(F.expr("sequence(1, int(w))")))
            tree = DecisionTreeRegressor(maxDepth=4, predictionCol=f"p{b}").fit(assemble(drawn, COLS, "y"))
            held = tree.transform(held)
        want.append(R2Evaluator().evaluate(held.withColumn("prediction", (F.col("p0") + F.col("p1") + F.col("p2")) / 3)))
    assert got == pytest.approx(np.mean(want), abs=1e-9)


def test_fits_beyond_the_bound_read_sums_of_equal_rows(spark, rows, monkeypatch):
    read, one_bag = [], T.one_bag
    monkeypatch.setattr(T, "one_bag", lambda *a: read.append(one_bag(*a)) or read[-1])
    monkeypatch.setattr(H, "tuned", None)
    many = rows.crossJoin(rows.sparkSession.range(10).withColumnRenamed("id", "copy")).withColumn("id", F.col("id") + 601 * F.col("copy"))
    H.tuned_forest(many, COLS, "y", "id", "fold", ["2"], trees=2, max_depth=2, rows_by_one=6000)
    assert len(read) == 6 and all(x.count() <= 3 * 28 for x in read)  # 2 x 2 x 7 patterns a fold, whatever the rows


def test_few_rows_are_drawn_one_by_one_and_folds_are_checked(rows):
    few = H.tuned_forest(rows, COLS, "y", "id", "fold", ["2", "all"], trees=2, max_depth=2)
    assert len(few) == 2 and all(0 < v < 1 for v in few)
    with pytest.raises(ValueError):
        H.tuned_forest(rows.filter("fold <> 1"), COLS, "y", "id", "fold", ["all"], rows_by_one=0)
