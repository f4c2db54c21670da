import numpy as np
import pytest
from pyspark.sql import functions as F

from broadloom.operators import sparse as S


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    n = 400
    a, b, x = rng.integers(0, 12, n), rng.integers(0, 5, n), rng.normal(size=n)
    y = 0.3 * a + (b == 2) * 2 - x + 0.1 * rng.normal(size=n)
    a[:130] = 3  # a third is one level
    rows = [(int(i), f"a{a[i]}", None if i % 50 == 0 else f"b{b[i]}", float(x[i]), float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id int, a string, b string, x double, y double").repartition(4), rows


def dense(rows, alpha):
    la, lb = sorted({r[1] for r in rows}), sorted({r[2] for r in rows if r[2]})
    m = np.array([[1.0, r[3], *[r[1] == v for v in la], *[r[2] == v for v in lb]] for r in rows], float)
    pen = alpha * np.eye(m.shape[1])
    pen[0, 0] = 0
    y = np.array([r[4] for r in rows])
    return m, np.linalg.solve(m.T @ m + pen, m.T @ y), y


@pytest.mark.parametrize("cells", [2_000_000, 0])
def test_equals_the_dense_fit(data, monkeypatch, cells):
    df, rows = data
    monkeypatch.setattr(S, "DRIVER_CELLS", cells)
    g = S.sparse_gram(df, ["x"], ["a", "b"], "y", "id")
    m, w, y = dense(rows, 2.0)
    full = np.zeros((g.width, g.width))
    for r in g.cells.filter("j >= 0").collect():
        full[r.i, r.j] = full[r.j, r.i] = r.v
    assert np.allclose(full, m.T @ m)
    model = S.sparse_ridge(g, 2.0)
    assert abs(model.intercept - w[0]) < 1e-8 and abs(model.coef["x"] - w[1]) < 1e-8
    out = model.transform(df.union(df.limit(1).withColumn("a", F.lit("new")).withColumn("id", F.lit(-1)))).collect()
    assert out[0].asDict().keys() == {"id", "a", "b", "x", "y", "pred"}
    got = {r.id: r.pred for r in out}
    assert len(out) == 401 and np.allclose([got[i] for i in range(400)], m @ w)


def test_fifty_thousand_dummies(spark):
    df = spark.range(120_000).select("id", F.concat(F.lit("k"), F.pmod(F.xxhash64("id"), F.lit(50_000))).alias("k"), (F.col("id") % 7).cast("string").alias("d"))
    df = df.withColumn("y", F.pmod(F.xxhash64("k"), F.lit(10)) + (F.col("d") == "3").cast("int") * 5.0)
    g = S.sparse_gram(df, [], ["k", "d"], "y", "id")
    assert g.width > 40_000 and g.cells.count() < 400_000
    model = S.sparse_ridge(g, 0.1)
    assert model.transform(df).agg(F.corr("y", "pred")).first()[0] > 0.99


def test_no_rows(spark):
    df = spark.createDataFrame([], "id int, a string, y double")
    model = S.sparse_ridge(S.sparse_gram(df, [], ["a"], "y", "id"))
    assert model.intercept == 0.0
