import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from broadloom.operators import gram as G, linear as L, search as H, stack as K, trees as T
from broadloom.operators.evaluate import early_stop, fold_report, one_se_choice, regression_metrics

COLS = [f"x{i}" for i in range(6)]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    n = 600
    x = rng.normal(size=(n, 6)) @ rng.normal(size=(6, 6)) + rng.normal(size=6)
    y = 3.0 + x @ np.array([2.0, 0, -1.0, 0, 0, 0.5]) + rng.normal(0, 0.3, n)
    rows = [(i, *map(float, x[i]), float(y[i]), i % 5) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{c} double" for c in COLS) + ", y double, fold int").repartition(3)
    df = df.cache()
    return df, x, y, G.gram(df, COLS, "y", "fold")


def centred(x, y):
    return x - x.mean(0), y - y.mean()


def test_gram_routes_agree(data, monkeypatch):
    df, x, y, g = data
    z = np.column_stack([x, y])
    for route in (0, 50):
        monkeypatch.setattr(G, "SQL_FEATURES", route)
        h = G.gram(df, COLS, "y", "fold")
        for k in range(5):
            n, s, m = h.sums(only=k)
            part = z[np.arange(len(z)) % 5 == k]
            assert n == len(part) and np.allclose(s, part.sum(0)) and np.allclose(m, part.T @ part)
    assert np.allclose(g.correlation(), np.corrcoef(z.T))
    coef, b0 = np.arange(6.0), 1.5
    part = np.arange(len(z)) % 5 == 2
    assert np.isclose(g.sse(2, coef, b0), np.sum((y[part] - x[part] @ coef - b0) ** 2))


def test_gram_skips_rows_with_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 5.0), (3.0, 4.0)], "a double, b double")
    n, s, _ = G.gram(df, ["a"], "b").sums()
    assert n == 2 and list(s) == [4.0, 6.0]


def test_ols_ridge_kernel(data):
    _, x, y, g = data
    xc, yc = centred(x, y)
    assert np.allclose(L.from_gram(g, L.ols_solve).coef, np.linalg.lstsq(xc, yc, rcond=None)[0])
    assert np.allclose(L.from_gram(g, lambda m: L.ridge_solve(m, 2.0)).coef, np.linalg.solve(xc.T @ xc + 2 * np.eye(6), xc.T @ yc))
    assert np.allclose(L.kernel_ridge_linear(g, 0.6).coef, np.linalg.solve(x.T @ x + 0.6 * np.eye(6), x.T @ y))


def lasso_by_subgradient(x, y, w, alpha, ratio):
    xc, yc = centred(x, y)
    grad = xc.T @ (yc - xc @ w) / len(y) - alpha * (1 - ratio) * w
    on = np.abs(w) > 1e-9
    return np.allclose(grad[on], alpha * ratio * np.sign(w[on]), atol=1e-6) and np.all(np.abs(grad[~on]) <= alpha * ratio + 1e-6)


@pytest.mark.parametrize("alpha,ratio", [(0.1, 1.0), (0.5, 1.0), (1.0, 0.5), (0.05, 0.2)])
def test_sparse_fits_are_optimal(data, alpha, ratio):
    df, x, y, g = data
    w = L.from_gram(g, lambda m: L.enet_solve(m, alpha, ratio)).coef
    assert lasso_by_subgradient(x, y, w, alpha, ratio)
    assert np.allclose(L.ml_linear(df, COLS, "y", alpha, ratio).coef, w, atol=1e-4)
    if ratio == 1.0:
        assert np.allclose(L.lars(g, alpha).coef, w, atol=1e-6)


def test_cv_matches_refits(data):
    _, x, y, g = data
    fold = np.arange(len(y)) % 5
    want = []
    for a in L.RIDGE_GRID:
        err = []
        for k in range(5):
            tr, te = fold != k, fold == k
            xc, yc = centred(x[tr], y[tr])
            w = np.linalg.solve(xc.T @ xc + a * np.eye(6), xc.T @ yc)
            err.append(np.mean((y[te] - y[tr].mean() - (x[te] - x[tr].mean(0)) @ w) ** 2))
        want.append(np.mean(err))
    got = L.ridge_cv(g)
    assert got.info["alpha"] == L.RIDGE_GRID[int(np.argmin(want))] and np.isclose(got.info["mse"], min(want))
    for model in (L.lasso_cv(g), L.enet_cv(g), L.lars_cv(g), L.omp_cv(g), L.pls_cv(g), L.pcr_cv(g)):
        assert model.info["mse"] < 1.05 * min(want) + 0.05


def test_path_methods(data):
    _, x, y, g = data
    w = L.omp(g, 3).coef
    assert set(np.flatnonzero(w)) <= set(range(6)) and np.count_nonzero(w) == 3
    full = L.from_gram(g, L.ols_solve).coef
    assert np.allclose(L.omp(g, 6).coef, full) and np.allclose(L.pls(g, 6).coef, full) and np.allclose(L.pcr(g, 6).coef, full)
    assert np.allclose(L.lasso_path(g.moments())[-1][1], full, atol=1e-8)
    assert np.allclose(L.bayes_ridge(g).coef, full, atol=0.05)
    for crit in ("aic", "bic"):
        m = L.lars_ic(g, crit)
        assert {0, 2, 5} <= set(np.flatnonzero(np.abs(m.coef) > 1e-9))


def test_leave_one_out(data):
    df, x, y, g = data
    got = {r["id"]: r["loo_pred"] for r in L.press(df, g, "y").select("id", "loo_pred").collect()}
    for i in (0, 17, 599):
        keep = np.arange(len(y)) != i
        a = np.column_stack([np.ones(keep.sum()), x[keep]])
        b = np.linalg.lstsq(a, y[keep], rcond=None)[0]
        assert np.isclose(got[i], b[0] + x[i] @ b[1:])


def test_robust_fits(data):
    df, x, y, _ = data
    bad = df.withColumn("y", F.col("y") + F.when(F.col("id") % 10 == 0, 200.0).otherwise(0.0))
    truth = np.array([2.0, 0, -1.0, 0, 0, 0.5])
    assert np.allclose(L.ml_linear(bad, COLS, "y", loss="huber", max_iter=200, tol=1e-8).coef, truth, atol=0.15)
    r = L.ransac(bad, COLS, "y", "id", trials=60, threshold=2.0)
    assert np.allclose(r.coef, truth, atol=0.1) and r.info["inliers"] >= 500
    assert r.info["trials"] <= 60
    again = L.ransac(bad.repartition(7), COLS, "y", "id", trials=60, threshold=2.0)
    assert np.allclose(r.coef, again.coef) and r.info == again.info


def test_ransac_draws_as_many_trials_as_the_inliers_ask_for(spark):
    rows = [(i, float(i % 50), 3.0 * (i % 50) + 1 if i % 5 < 2 else float((i * 7919) % 997)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, a double, y double")
    r = L.ransac(df, ["a"], "y", "id", trials=100, threshold=0.5, at_once=4)
    assert abs(r.coef[0] - 3) < 1e-6 and 4 < r.info["trials"] < 100
    same = df.withColumn("a", F.lit(1.0))
    with pytest.raises(ValueError):
        L.ransac(same, ["a"], "y", "id", trials=10)


def test_glm_keeps_real_terms(data):
    df, *_ = data
    kept = {r["term"] for r in L.glm_terms(df, COLS, "y", 1e-6).collect()}
    assert {"x0", "x2", "x5"} <= kept <= {"x0", "x2", "x5", "(intercept)"}


def test_fold_models_and_scores(data):
    df, x, y, g = data
    fold = np.arange(len(y)) % 5
    models = K.fit_folds(df, COLS, "y", "id", 5, "ols", g=g)
    rows = {r["id"]: r for r in K.score_folds(df, models, "fold").collect()}
    assert len(rows) == len(y)
    oof, preds = np.zeros(len(y)), np.zeros((len(y), 5))
    for k in range(5):
        tr = fold != k
        a = np.column_stack([np.ones(tr.sum()), x[tr]])
        b = np.linalg.lstsq(a, y[tr], rcond=None)[0]
        preds[:, k] = b[0] + x @ b[1:]
    oof = preds[np.arange(len(y)), fold]
    assert np.allclose([rows[i]["oof_pred"] for i in range(len(y))], oof)
    assert np.allclose([rows[i]["mean_pred"] for i in range(len(y))], preds.mean(1))
    r2 = lambda a, b: 1 - np.sum((a - b) ** 2) / np.sum((a - a.mean()) ** 2)
    scored = K.score_all(df, {"ols": models}, ["id", "fold", "y"], "fold")
    m = K.fold_scores(scored).first()
    assert np.isclose(m["oof_r2"], r2(y, oof)) and m["n"] == len(y)
    assert np.isclose(m["fold_r2"], np.mean([r2(y[fold == k], oof[fold == k]) for k in range(5)]))
    assert np.isclose(m["infold_r2"], np.mean([r2(y[fold != k], preds[fold != k, k]) for k in range(5)]))
    rep = fold_report(scored, "y", "oof_pred").first()
    assert np.isclose(rep["oof_r2"], m["oof_r2"]) and np.isclose(rep["fold_r2"], m["fold_r2"])


def test_registry_mixes_learners(data):
    df, *_ = data
    tr, te, metrics = K.run_registry(df, df.drop("y"), COLS, "y", "id", 5, ["ridge", "lasso", "tree"])
    assert tr.groupBy("model").count().filter("count = 600").count() == 3
    assert te.groupBy("model").count().filter("count = 600").count() == 3
    m = {r["model"]: r for r in metrics.collect()}
    assert m["ridge"]["oof_r2"] > 0.9 and m["tree"]["infold_r2"] > m["tree"]["oof_r2"]


def test_super_learner_beats_worst_base(data):
    df, *_ = data
    train, test, meta = K.super_learner(df, df, COLS, "y", "id", 5, ["ridge", "tree"], "ridge_cv")
    assert train.count() == 600 and test.count() == 600
    assert regression_metrics(train, "y", "pred").first()["r2"] > 0.9


def test_stacking_step(data):
    df, *_ = data
    x = L.assemble(df, COLS, "y")
    model = Pipeline(stages=[K.PredictionFeature(LinearRegression()), LinearRegression()]).fit(x)
    step = model.stages[0].transform(x)
    assert step.first()["features"].size == 7 and "prediction" not in step.columns
    assert regression_metrics(model.transform(x), "label", "prediction").first()["r2"] > 0.9


def test_blend_checks_weights(spark):
    m = spark.createDataFrame([(1, 1.0, 3.0)], "ID int, a double, b double")
    assert K.blend(m, {"a": 0.25, "b": 0.75}).first()["y"] == 2.5
    with pytest.raises(ValueError):
        K.blend(m, {"a": 0.5, "b": 0.6})


def test_grid_stops_early(data):
    *_, g = data
    rows = H.grid_trials(g, "y", lambda z, j: COLS[:z], lambda m, z, j: L.ols_solve(m), [1, 6], [1, 2], stop_above=0.9)
    assert len(rows) == 3 and rows[-1][3] > 0.9


def test_boosting_bagging_adaboost(data):
    df, x, y, _ = data
    for model in (T.boosted(df, COLS, "y", rounds=10, step=0.3), T.bagged_trees(df, COLS, "y", "id", bags=3),
                  T.adaboost_r2(df, COLS, "y", "id", rounds=4, learning_rate=1.0, cut_every=2)):
        assert regression_metrics(model.transform(df), "y", "pred").first()["r2"] > 0.6
    ada = T.adaboost_r2(df, COLS, "y", "id", rounds=3, learning_rate=1.0)
    cols = df
    for i, m in enumerate(ada.models):
        cols = m.transform(cols, f"t{i}")
    rows = ada.transform(cols).collect()
    for r in rows[:50]:
        p = np.array([r[f"t{i}"] for i in range(len(ada.models))])
        w = np.array(ada.weights)
        o = np.argsort(p)
        assert r["pred"] == p[o][np.searchsorted(np.cumsum(w[o]), 0.5 * w.sum())]


def test_isolation_forest_finds_planted(spark):
    df = spark.range(3000).select("id", F.sin("id").alias("a"), F.cos(F.col("id") * 3).alias("b"))
    df = df.withColumn("a", F.when(F.col("id") % 100 == 0, 9.0 + F.col("a")).otherwise(F.col("a")))
    model = T.isolation_forest(df, ["a", "b"], "id", trees=40)
    assert len(model.forest) == 40
    out = T.outlier_flags(model, df, 0.02)
    assert out.filter("flag = -1 and id % 100 = 0").count() >= 29
    assert abs(out.filter("flag = -1").count() - 60) <= 1


def test_metric_edges(spark):
    one = spark.createDataFrame([(2.0, 1.0)], "y double, p double")
    r = regression_metrics(one, "y", "p").first()
    assert r["n"] == 1 and r["r2"] is None and r["rmse"] == 1.0
    rounds = spark.createDataFrame([(0, i, v) for i, v in enumerate([5.0, 4.0, 4.5, 4.0, 4.2, 1.0])], "fold int, round int, m double")
    assert tuple(early_stop(rounds, "m", 2).first()) == (0, 3, 1, 4.0)
    assert tuple(early_stop(rounds, "m", 10).first()) == (0, 5, 5, 1.0)
    assert tuple(early_stop(rounds, "m", 1, maximize=True).first()) == (0, 1, 0, 5.0)
    log = spark.createDataFrame([(c, c, v) for c, vs in enumerate([(.5, .7), (.6, .64), (.1, .1)]) for v in vs], "c int, size int, m double")
    assert one_se_choice(log, "c", "m", "size").first()["c"] == 0


def test_row_sums_scores_and_leverage_at_400_columns(spark, tmp_path):
    from broadloom.functions.columns import linear_score, row_sum
    from broadloom.operators.gram import gram
    from broadloom.operators.linear import press

    import pandas as pd

    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 400))
    names = [f"c{i}" for i in range(400)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(y=x[:, 0] + rng.normal(size=900)))
    df.write.parquet(str(tmp_path / "wide"))
    df = spark.read.parquet(str(tmp_path / "wide"))
    got = df.select(row_sum(names).alias("s"), linear_score(names, np.arange(400.0), 2.0).alias("l"), "c0").toPandas().sort_values("c0")
    order = np.argsort(x[:, 0])
    assert np.allclose(got["s"], x.sum(1)[order]) and np.allclose(got["l"], (2 + x @ np.arange(400.0))[order])
    out = press(df, gram(df, names, "y"), "y").select("c0", "leverage").toPandas().sort_values("c0")
    z = np.c_[np.ones(900), x]
    assert np.allclose(out["leverage"], np.einsum("ij,ij->i", z @ np.linalg.inv(z.T @ z), z)[order])


def test_moments_of_large_values_with_a_small_spread(spark):
    from pyspark.sql import functions as F

    from broadloom.operators.gram import gram
    from broadloom.operators.linear import from_gram, ols_solve

    df = spark.range(7).select((F.col("id") + 1e9).alias("x"), (F.col("id") + 1e9).alias("x2"), (F.col("id") * 1.0).alias("y"))
    g = gram(df, ["x"], "y")
    model = from_gram(g, ols_solve)
    assert np.isclose(model.coef[0], 1.0) and np.isclose(g.moments().sxx[0, 0], 28.0)
    assert np.isclose(gram(df, ["x", "x2"]).correlation()[0, 1], 1.0)
    assert np.isclose(g.sse(0, model.coef, model.intercept), 0.0, atol=1e-6)


def test_penalty_path_meets_its_optimality_conditions(spark):
    import time

    from broadloom.operators.gram import Gram
    from broadloom.operators.linear import enet_solve, lasso_cv

    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 400)) @ (np.eye(400) + 0.05 * rng.normal(size=(400, 400)))
    y = x[:, :20] @ rng.normal(size=20) + rng.normal(size=2000)
    z = np.c_[x, y]
    g = Gram([f"c{i}" for i in range(400)] + ["y"], {k: (400.0, z[k::5].sum(0), z[k::5].T @ z[k::5]) for k in range(5)})
    start = time.time()
    lasso_cv(g)
    assert time.time() - start < 60
    m, alpha = g.moments(), 0.05
    w = enet_solve(m, alpha, 0.5)
    slope = (m.sxy - m.sxx @ w) / m.n - 0.025 * w
    assert np.allclose(slope[w != 0], 0.025 * np.sign(w[w != 0]), atol=1e-6) and np.all(np.abs(slope[w == 0]) <= 0.025 + 1e-6)


def test_null_and_ragged_arrays_are_left_out(spark):
    from broadloom.operators.gram import gram_array

    df = spark.createDataFrame([([1.0, 2.0],), (None,), ([3.0],), ([1.0, None],), ([2.0, 5.0],)], "v array<double>")
    n, s, g = gram_array(df, "v", 2).sums()
    assert n == 2 and np.allclose(s, [3, 7]) and np.allclose(g, [[5, 12], [12, 29]])


def test_nested_layers_see_no_row_twice(spark):
    rng = np.random.default_rng(8)
    n, k = 300, 3
    x = rng.normal(size=(n, 3))
    y = x @ [1.0, -2.0, 0.5] + x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=n)
    fold = np.arange(n) % k
    rows = [(int(i), *map(float, x[i]), float(y[i]), int(fold[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, y double, fold int").repartition(3)
    bases = {"one": ("ols", ["a"]), "two": ("ols", ["b", "c"])}
    train, test = df.filter("id < 240"), df.filter("id >= 240")
    oof, preds, scores = K.nested_registry(train, test, "y", "id", k, bases, ["ols", "tree"])

    def fit(z, t):
        w = np.linalg.lstsq(np.c_[z, np.ones(len(z))], t, rcond=None)[0]
        return lambda q: np.c_[q, np.ones(len(q))] @ w

    m = np.arange(n) < 240
    want, probe = np.zeros(n), np.zeros(60)
    for f in range(k):
        z = np.zeros((n, 2))
        for at, cols in enumerate(([0], [1, 2])):
            for j in range(k):
                part = m & (fold != f) & (fold != j)
                z[fold == j, at] = fit(x[part][:, cols], y[part])(x[fold == j][:, cols])
        top = fit(z[m & (fold != f)], y[m & (fold != f)])
        want[fold == f] = top(z[fold == f])
        alone = m & (fold != f)
        q = np.c_[fit(x[alone][:, [0]], y[alone])(x[240:][:, [0]]), fit(x[alone][:, [1, 2]], y[alone])(x[240:][:, [1, 2]])]
        probe += top(q) / k
    got = {r.id: r.pred for r in oof.filter("model = 'ols'").collect()}
    assert len(got) == 240 and np.allclose([got[i] for i in range(240)], want[:240])
    got = {r.id: r.pred for r in preds.filter("model = 'ols'").collect()}
    assert np.allclose([got[i] for i in range(240, 300)], probe)
    assert {r.model: r.n for r in scores.collect()} == {"ols": 240, "tree": 240} and preds.count() == 120


def test_nested_layers_choose_penalties_by_folds(spark):
    """With two of three folds left out a single one is left, too few to choose by."""
    rng = np.random.default_rng(4)
    n, k = 240, 3
    x = rng.normal(size=(n, 4))
    y = 0.2 * x[:, 0] + 2 * rng.normal(size=n)  # weak: the greatest ridge penalty is best, and not the greatest of the lasso
    rows = [(int(i) if i % 3 else None, *map(float, x[i]), float(y[i]), int(i // 2 % k)) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double, y double, fold int").repartition(3)
    cols = list("abcd")
    bases = {"ridge": ("ridge_cv", cols), "lasso": ("lasso_cv", cols), "plain": ("ols", cols)}
    fitted = K._fit_pairs(df, "y", "id", k, bases, "fold")
    got = df.select(*cols, "y", "fold", K.part_of(["id", *cols, "y"]).alias("p")).toPandas()
    z, t, fold, part = got[cols].to_numpy(), got["y"].to_numpy(), got["fold"].to_numpy(), got["p"].to_numpy()

    def solve(rows, a):
        xc, yc = centred(z[rows], t[rows])
        w = np.linalg.solve(xc.T @ xc + a * np.eye(4), xc.T @ yc)
        return w, t[rows].mean() - z[rows].mean(0) @ w

    assert len(fitted) == 18
    for left in [(f,) for f in range(k)] + [(0, 1), (0, 2), (1, 2)]:
        mine = ~np.isin(fold, left)
        mse = []
        for a in L.RIDGE_GRID:
            errors = []
            for p in range(K.PARTS):
                w, b = solve(mine & (part != p), a)
                errors.append(np.mean((t - z @ w - b)[mine & (part == p)] ** 2))
            mse.append(np.mean(errors))
        best = fitted["ridge", left]
        assert best.info["alpha"] == L.RIDGE_GRID[int(np.argmin(mse))] and np.isclose(best.info["mse"], min(mse))
        assert np.allclose(best.coef, solve(mine, best.info["alpha"])[0])
        assert np.allclose(fitted["plain", left].coef, solve(mine, 0.0)[0])
        assert np.isfinite(fitted["lasso", left].info["mse"])
    assert {fitted["ridge", left].info["alpha"] for left in [(0, 1), (0, 2), (1, 2)]} != {L.RIDGE_GRID[0]}
    with pytest.warns(RuntimeWarning, match="nothing to choose alpha by"):
        L.ridge_cv(G.gram(df.filter("fold = 0"), cols, "y", "fold"))


def test_rows_count_in_every_fold_of_an_array(data):
    df, *_ = data
    both = df.withColumn("cells", F.array("fold", (F.col("id") % 2 + 5).cast("int")))
    got = G.gram(both, COLS, "y", "cells")
    for name, cells in (("fold", range(5)), ("half", (5, 6))):
        want = G.gram(df.withColumn("half", (F.col("id") % 2 + 5).cast("int")), COLS, "y", name)
        for c in cells:
            assert all(np.allclose(a, b) for a, b in zip(got.sums(only=c), want.sums(only=c)))


def test_linear_scores_equal_those_of_repeated_rows(data):
    df, _, _, g = data
    odd = df.withColumn("y", F.when(F.col("id") % 7 > 0, F.col("y"))).withColumn("x0", F.when(F.col("id") % 11 > 0, F.col("x0")))
    fitted = {n: [L.from_gram(g.without_fold(f), s) for f in range(5)] for n, s in (("a", L.ols_solve), ("b", lambda m: L.ridge_solve(m, 9.0)))}
    want = {r.model: r for r in K.fold_scores(K.score_all(odd, fitted, ["fold", "y"], "fold")).collect()}
    got = {r.model: r for r in K.linear_scores(odd, fitted, "y", "fold", 3.0).collect()}
    for m in "ab":
        assert got[m].n == want[m].n and np.allclose(list(got[m])[1:], list(want[m])[1:])


def test_group_index_does_not_depend_on_slices(data, monkeypatch):
    from broadloom.operators import ordering as O
    df, *_ = data
    for least in (16, 3):  # by the session's shuffles, and dealt over as many tasks as slices
        monkeypatch.setattr(O, "LEAST_SLICES", least)
        got = O.group_index(df.select("id", "fold"), "fold", "id", 7, rows_per_bucket=100)
        assert sorted((r.fold, r.idx) for r in got.collect()) == [(f, i) for f in range(5) for i in range(120)]
        assert least == 16 or O.spread_by(df, "id", 600, 100).rdd.getNumPartitions() == 6


def test_linear_and_other_bases_predict_side_by_side(data):
    df, _, _, g = data
    one, two = (L.from_gram(g, lambda m, a=a: L.ridge_solve(m, a)) for a in (1.0, 50.0))
    boosted, bags = T.boosted(df, COLS, "y", rounds=2), T.bagged_trees(df, COLS, "y", "id", bags=2)
    for models in ([one, boosted, two], [boosted, one, bags]):
        got = K._all_predictions(df, models).drop("y")
        for i, m in enumerate(models):
            got = m.transform(got, f"p{i}")
        assert all(np.allclose(r["__all"], [r[f"p{i}"] for i in range(3)]) for r in got.collect())


def test_nested_layers_have_boosting_below(monkeypatch):
    from broadloom.plans import q_model as Q

    seen = {}

    def stop(train, test, y, key, k, bases, metas):
        seen.update(bases)
        raise InterruptedError

    class Rows:
        def withColumn(self, *_):
            return self

    monkeypatch.setattr(Q, "halves", lambda *_: (Rows(), None))
    monkeypatch.setattr(Q.F, "expr", lambda text: text)
    monkeypatch.setattr(K, "nested_registry", stop)
    with pytest.raises(InterruptedError):
        Q.nested_layers(None, "")
    assert [learner for learner, _ in seen.values()] == ["ridge_cv", "lasso_cv", "omp", "gbt"]
