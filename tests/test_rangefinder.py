import numpy as np
import pytest
from pyspark.sql import functions as F

from broadloom.operators import rangefinder as R


@pytest.mark.parametrize("centre, scale", [(True, False), (False, False), (True, True)])
def test_agrees_with_the_dense_decomposition(spark, centre, scale):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4)) * [9, 5, 3, 2] @ rng.normal(size=(4, 60)) + 0.3 * rng.normal(size=(300, 60)) + 7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0])], "id int, x array<double>").repartition(5)
    got = R.leading(df, "x", 60, 3, centre, scale)
    m = (x - x.mean(0) * centre) / (x.std(0, ddof=1) if scale else 1)
    _, s, v = np.linalg.svd(m, full_matrices=False)
    assert np.allclose(got.info["singular"], s[:3]) and 1 < got.info["passes"] < 40
    z = np.array([r.pca for r in got.transform(df.filter("id < 900"), "x").orderBy("id").collect()])
    want = m @ v[:3].T
    assert np.allclose(np.abs(z), np.abs(want), atol=1e-5)


def test_twenty_thousand_columns(spark):
    width = 20_000

    def make(batches):
        import pandas as pd

        base = np.random.default_rng(1).normal(size=(3, width))
        for pdf in batches:
            rows = [(np.random.default_rng(100 + i).normal(size=3) * [30, 10, 4]) @ base + np.random.default_rng(i).normal(size=width) for i in pdf.id]
            yield pd.DataFrame({"x": rows})

    df = spark.range(0, 120, 1, 4).mapInPandas(make, "x array<double>")
    got = R.leading(df, "x", width, 3, centre=False, prefix="svd")
    x = np.stack([r.x for r in df.collect()])
    assert np.allclose(got.info["singular"], np.linalg.svd(x, compute_uv=False)[:3], rtol=1e-7)
    assert got.matrix.shape == (width, 3) and np.allclose(got.matrix.T @ got.matrix, np.eye(3), atol=1e-9)


def test_no_rows_and_few(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<double>")
    assert R.leading(df.filter(F.lit(False)), "x", 3, 2).info["passes"] == 0
    one = R.leading(df, "x", 3, 2, centre=False)
    assert np.allclose(one.info["singular"], [np.sqrt(14), 0])
