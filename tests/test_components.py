import itertools
import math

import numpy as np
import pytest
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import functions as F

from broadloom.operators import decompose as D, rules as U, sampling as S
from broadloom.operators.density import kernel_density

P, K = 8, 3


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, K)) @ rng.normal(size=(K, P)) * 3 + rng.normal(size=(400, P)) * 0.1 + 2.0
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, x array<double>").repartition(3)
    return df.cache(), x


def matrix(df, fitted):
    rows = sorted(fitted.transform(df, "x", "c").select("id", "c").collect())
    return np.array([r["c"] for r in rows])


def test_pca(data):
    df, x = data
    fitted = D.pca(df, "x", K)
    c = matrix(df, fitted)
    xc = x - x.mean(0)
    v = D.fix_signs(np.linalg.svd(xc, full_matrices=False)[2].T[:, :K])
    assert np.allclose(c, xc @ v, atol=1e-6)
    assert np.allclose(np.corrcoef(c.T), np.eye(K), atol=1e-6)
    _, keep = D.pca_cut(df, "x", P)
    assert 1 <= keep <= 5


def test_svd_and_projections(data):
    df, x = data
    fitted = D.truncated_svd(df, "x", K)
    s = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(fitted.info["singular"], s[1][:K]) and np.allclose(matrix(df, fitted), x @ D.fix_signs(s[2].T[:, :K]), atol=1e-6)
    for make in (D.gaussian_projection, D.sparse_projection):
        a, b = make(P, K, seed=3), make(P, K, seed=3)
        assert np.array_equal(a.matrix, b.matrix) and np.allclose(matrix(df, a), x @ a.matrix)
    m = D.sparse_projection(400, 20).matrix
    assert set(np.round(np.unique(np.abs(m)), 9)) == {0.0, round(math.sqrt(20 / 20), 9)}
    assert abs(np.mean(m != 0) - 1 / 20) < 0.01


def test_components_append(data):
    df, _ = data
    out = D.append_components(D.gaussian_projection(P, K).transform(df, "x"), "grp", K)
    assert out.columns == ["id", "x", "grp_1", "grp_2", "grp_3"]


def test_ica_recovers_sources(spark):
    i = np.arange(2000)
    s = np.column_stack([(i % 17) - 8.0, np.sin(i)])
    x = s @ np.array([[1.0, 0.6], [0.4, 1.0]])
    df = spark.createDataFrame([(int(k), [float(a), float(b)]) for k, (a, b) in enumerate(x)], "id int, x array<double>")
    fitted = D.fast_ica(df, "x", 2, 2, tol=1e-6)
    c = np.abs(np.corrcoef(matrix(df, fitted).T, s.T)[:2, 2:])
    assert c.max(axis=1).min() > 0.98 and fitted.info["gap"] < 1e-6
    assert np.allclose(np.var(matrix(df, fitted), axis=0), 1.0, atol=1e-6)


def test_nmf_is_nonnegative_and_improves(data):
    df, x = data
    fitted = D.nmf(df, "x", P, K, max_iter=15)
    w = matrix(df, fitted)
    assert (w >= 0).all() and (fitted.h >= 0).all()
    assert all(b <= a + 1e-6 * abs(a) for a, b in zip(fitted.losses, fitted.losses[1:]))
    assert np.sum((np.abs(x) - w @ fitted.h) ** 2) < 0.2 * np.sum(np.abs(x) ** 2)


def pattern_growth(df, flags, min_support, low=2, high=4):
    """(items sorted, size, freq) by Spark ML."""
    fit = FPGrowth(itemsCol="items", minSupport=min_support).fit(U.transactions(df, flags, "id").select("items"))
    sized = fit.freqItemsets.withColumn("size", F.size("items")).filter(F.col("size").between(low, high))
    return sized.select(F.array_sort("items").alias("items"), "size", "freq")


def test_itemsets_against_brute_force(spark):
    flags = ["a", "b", "c", "d"]
    rows = [(i, int(i % 2 == 0), int(i % 3 == 0), int(i % 4 < 3), int(i % 7 == 0)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, a int, b int, c int, d int")
    got = {r["items"] if isinstance(r["items"], str) else ",".join(r["items"]): r
           for r in U.itemset_lift(df, flags, pattern_growth(df, flags, 0.05)).collect()}
    m = np.array([r[1:] for r in rows])
    for size in (2, 3, 4):
        for c in itertools.combinations(range(4), size):
            n = int(m[:, c].all(axis=1).sum())
            name = ",".join(flags[i] for i in c)
            assert (name in got) == (n >= 25)
            if name in got:
                lift = n / 500 / np.prod(m[:, c].mean(axis=0))
                assert got[name]["freq"] == n and abs(got[name]["lift"] - lift) < 1e-9
    pairs = U.pair_counts(df.withColumn("d", F.lit(0)), flags)
    d = {(r["a"], r["b"]): r["d"] for r in U.phi_dissimilarity(pairs).collect()}
    assert abs(d[("a", "b")] - (1 - np.corrcoef(m[:, 0], m[:, 1])[0, 1])) < 1e-9 and d[("a", "d")] == 1.0


@pytest.mark.parametrize("chunk", [1000, 2])
def test_residuals_hold_empty_cells(spark, chunk):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), ("b", "z"), ("b", "w")], "p string, q string")
    rows = U.association_residuals(df, "p", "q", chunk).collect()
    assert len(rows) == 8 and abs(sum(r["expected"] for r in rows) - 5) < 1e-12
    cell = next(r for r in rows if (r["p"], r["q"]) == ("b", "x"))
    assert cell["n"] == 0 and abs(cell["residual"] + math.sqrt(1.2)) < 1e-12


def test_density_integrates_to_one(spark):
    df = spark.range(5000).select(F.sin("id").alias("v"))
    rows = sorted(kernel_density(df, "v", 200, 0.05).collect())
    x, d = np.array([r["x"] for r in rows]), np.array([r["density"] for r in rows])
    exact = np.exp(-0.5 * ((x[:, None] - np.sin(np.arange(5000))) / 0.05) ** 2).mean(axis=1) / (0.05 * math.sqrt(2 * math.pi))
    assert np.allclose(d, exact, rtol=1e-9)
    assert kernel_density(df.filter("v > 5"), "v").count() == 0


def test_resample_follows_test_levels(spark):
    level = lambda c: F.concat(F.lit("l"), c.cast("string"))
    train = spark.range(300).select("id", level(F.col("id") % 3).alias("c")).unionByName(
        spark.createDataFrame([(1000, "rare")], "id bigint, c string"))
    test = spark.range(400).select("id", F.when(F.col("id") < 130, "rare").when(F.col("id") < 140, "new")
                                   .otherwise(level(F.col("id") % 3)).alias("c"))
    out = S.stratified_resample(train, test, "c", "id", 1)
    assert out.count() == 400
    got = {r["c"]: r["count"] for r in out.filter("draw is not null").groupBy("c").count().collect()}
    want = {r["c"]: r["count"] for r in test.filter("c <> 'new'").groupBy("c").count().collect()}
    assert got == want and out.filter("draw is null").select("id").distinct().count() == 10


def test_folds_and_bags(spark):
    df = spark.range(503).withColumn("y", F.col("id") * 1.5)
    f = S.stratified_folds(df, "id", "y", 5, 2, 1).toPandas()
    assert set(f["bin"]) == set(range(5))
    for c in ("fold_1", "fold_2"):
        sizes = f.groupby(["bin", c]).size()
        assert sizes.max() - sizes.min() <= 1
    assert not (f["fold_1"] == f["fold_2"]).all()
    w = S.with_poisson_weight(df, "id", 3).toPandas()["w"]
    assert abs(w.mean() - 1) < 0.15 and abs(w.var() - 1) < 0.3
    h = S.seeded_holdouts(df, "id", 0.2, range(4)).groupBy("seed").count().collect()
    assert len(h) == 4 and all(60 < r["count"] < 145 for r in h)
    again = S.holdout(df.repartition(7), "id", 0.2, 2).filter("holdout").count()
    assert again == S.holdout(df, "id", 0.2, 2).filter("holdout").count()


def test_density_with_a_bandwidth_far_below_the_range(spark):
    """One far value must not blur the others."""
    v = np.append(np.linspace(0, 1, 999), 100_000.0)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    rows = {r["g"]: r for r in kernel_density(df, "v", 200, 0.2).collect()}
    x = np.array([rows[g]["x"] for g in range(200)])
    exact = np.exp(-0.5 * ((x[:, None] - v) / 0.2) ** 2).mean(axis=1) / (0.2 * math.sqrt(2 * math.pi))
    assert np.allclose([rows[g]["density"] for g in range(200)], exact, rtol=1e-9, atol=1e-15) and rows[0]["density"] > 0.49


def test_encoding_reads_a_large_column_once(spark, tmp_path):
    """Three large columns: one scan of the table in the plan, one join each."""
    from broadloom.operators.lookup import Levels

    spark.range(3000).select("id", *[F.concat(F.lit("v"), F.pmod(F.xxhash64("id", F.lit(i)), F.lit(900)).cast("string")).alias(f"c{i}")
                                     for i in range(3)]).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    cols = ["c0", "c1", "c2"]
    levels = Levels(df, cols, "id", max_rows=5).number()
    out = df
    for c in cols:
        out = levels.attach(out, c, **{f"{c}_code": "code", f"{c}_freq": "n"})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 3 and out.count() == 3000


@pytest.mark.parametrize("block, cells", [(8192, 1 << 22), (16, 4)])
def test_frequent_sets_agree_with_pattern_growth(spark, monkeypatch, block, cells):
    monkeypatch.setattr(U, "BLOCK_PATTERNS", block)
    monkeypatch.setattr(U, "PASS_CELLS", cells)
    flags = ["e", "b", "c", "d", "a"]
    df = spark.range(400).select("id", *[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(i + 2)) == 0).cast("int").alias(c) for i, c in enumerate(flags)])
    for high in (1, 3, 4):
        want = {tuple(r["items"]): r["freq"] for r in pattern_growth(df, flags, 8 / 400, 1, high).collect()}
        got = {tuple(r["items"]): r["freq"] for r in U.frequent_sets(df, flags, "id", 8, high).collect()}
        assert got == want


def test_frequent_sets_of_many_flags_nulls_and_none(spark):
    rng = np.random.default_rng(1)
    m = rng.random((3000, 370)) < np.r_[np.full(30, 0.4), np.full(340, 0.02)]
    names = [f"f{i}" for i in range(370)]
    rows = [tuple(int(v) if v or i % 7 else None for v in r) for i, r in enumerate(m)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in names))
    got = {tuple(r["items"]): r["freq"] for r in U.frequent_sets(df, names, "f0", 100, 4).collect()}
    pick = {c: m[:, i] for i, c in enumerate(names)}
    assert all(n == np.logical_and.reduce([pick[c] for c in s]).sum() >= 100 for s, n in got.items())
    often = [c for c in names if pick[c].sum() >= 100]
    for k in (1, 2, 3):
        assert sum(len(s) == k for s in got) == sum(np.logical_and.reduce([pick[c] for c in s]).sum() >= 100 for s in itertools.combinations(often, k))
    assert U.frequent_sets(df.limit(0), names, "f0", 1, 4).collect() == []
