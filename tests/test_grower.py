import numpy as np
import pytest
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from broadloom.operators import flat_trees as FT, grower as G, search as H, trees as T
from broadloom.operators.linear import assemble

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    a, b, c = rng.integers(0, 2, 900), rng.integers(0, 5, 900), np.round(rng.normal(size=900), 3)
    y = 3.0 * a + b * a + 2 * (c > 0.3) + 0.2 * rng.normal(size=900)
    return [(int(i), int(a[i]), int(b[i]), float(c[i]), float(y[i]), int(i % 3)) for i in range(900)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id bigint, a int, b int, c double, y double, fold int").repartition(6).cache()


def test_flat_trees_score_like_spark(df):
    for est in (lambda: T.tree(df, COLS, "y"), lambda: T.forest(df, COLS, "y", trees=4), lambda: T.boosted(df, COLS, "y", rounds=4)):
        m = est()
        flat = FT.from_ml(m.model)
        weights = np.array(getattr(m.model, "treeWeights", [1.0]), float)
        weights = weights / weights.sum() if m.model.__class__.__name__.startswith("RandomForest") else weights
        got = FT.FlatModel(flat, weights, COLS, m.base).transform(m.transform(df, "want"), "got")
        assert got.select(F.max(F.abs(F.col("want") - F.col("got")))).first()[0] < 1e-9


def test_staged_scores_equal_each_iteration(df):
    model = T.boosted(df.filter("fold > 0"), COLS, "y", rounds=50, step=0.3)
    data = assemble(df.filter("fold = 0"), COLS, "y").withColumn("label", F.col("label") - F.lit(model.base)).select("features", "label")
    want = np.sqrt(model.model.evaluateEachIteration(data, "squared"))
    assert np.allclose(T.boosting_curve(model, df.filter("fold = 0"), "y"), want)


def test_round_curve_scores_each_fold_by_its_own_model(df):
    got = {(r.fold, r.round): r for r in H.round_curve(df, COLS, "y", "fold", 3, rounds=3, max_depth=2).collect()}
    assert set(got) == {(f, r) for f in range(3) for r in range(3)}
    model = T.boosted(df.filter("fold <> 1"), COLS, "y", rounds=3, max_depth=2)
    held = model.transform(df.filter("fold = 1")).agg((1 - F.sum(F.pow(F.col("y") - F.col("pred"), 2)) / (F.var_pop("y") * F.count("y")))).first()[0]
    assert abs(got[1, 2].r2 - held) < 1e-9 and got[1, 2].n == 300


def test_weighted_median():
    v, w = np.array([[3.0, 1.0, 2.0], [5.0, 5.0, 1.0]]), np.array([0.2, 0.5, 0.3])
    assert FT.weighted_median(v, w).tolist() == [1.0, 5.0]


def plain_tree(x, y, depth):
    """Best splits by brute force, as nested tuples."""
    if depth and len(y) > 1:
        best = max(((sum(len(s) * s.mean() ** 2 for s in (y[x[:, j] <= t], y[x[:, j] > t])), -j, -t)
                    for j in range(x.shape[1]) for t in np.unique(x[:, j])[:-1]), default=None)
        if best is not None and best[0] > len(y) * y.mean() ** 2 + 1e-9:
            j, t = -best[1], -best[2]
            return j, t, plain_tree(x[x[:, j] <= t], y[x[:, j] <= t], depth - 1), plain_tree(x[x[:, j] > t], y[x[:, j] > t], depth - 1)
    return float(y.mean())


def plain_score(node, row):
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node


def test_boosting_equals_brute_force(df, rows):
    data = np.array([r[1:3] for r in rows], float), np.array([r[4] for r in rows])
    for alone in (4, 0):  # cells straight to the driver, and added up on the executors
        before, G.FEW_TASKS = G.FEW_TASKS, alone
        model = G.boost(df, ["a", "b"], "y", "id", rounds=4, step=0.5, max_depth=2, rewrite_every=2)
        G.FEW_TASKS = before
        f = np.full(900, data[1].mean())
        for _ in range(4):
            tree = plain_tree(data[0], data[1] - f, 2)
            f = f + 0.5 * np.array([plain_score(tree, r) for r in data[0]])
        got = {r.id: r.pred for r in model.transform(df).collect()}
        assert np.allclose([got[i] for i in range(900)], f)


def test_early_stop_keeps_the_best_round(df):
    marked = df.withColumn("judge", F.col("fold") == 0).withColumn("t", F.when(F.col("judge"), F.col("y") * 0.5 + 1).otherwise(F.col("y")))
    model = G.boost(marked, COLS, "t", "id", rounds=60, step=0.2, max_depth=2, validation="judge", patience=4)
    curve, info = model.info["curve"], model.info
    assert info["best_round"] == int(np.argmax(curve)) and info["stop_round"] == info["best_round"] + 4 == len(curve) - 1
    assert len(model.trees.roots) == info["best_round"] + 1
    held = model.transform(marked.filter("judge")).agg((1 - F.sum(F.pow(F.col("t") - F.col("pred"), 2)) / (F.var_pop("t") * F.count("t")))).first()[0]
    assert abs(held - max(curve)) < 1e-9
    whole = G.boost(marked, COLS, "t", "id", rounds=3, max_depth=1, validation="judge")
    assert len(whole.info["curve"]) == 3 and whole.info["stop_round"] == 2


def test_huber_resists_outliers(df):
    wild = df.withColumn("t", F.col("y") + F.when(F.col("id") % 29 == 0, 1000.0).otherwise(0.0))
    err = {}
    for loss in ("squared", "huber"):
        model = G.boost(wild, COLS, "t", "id", rounds=15, step=0.3, max_depth=2, loss=loss, seed=2)
        err[loss] = model.transform(df).agg(F.avg(F.abs(F.col("y") - F.col("pred")))).first()[0]
    assert err["huber"] < 0.6 < err["squared"]


def test_extra_trees_draw_their_cuts(df):
    model = G.extra_trees(df, COLS, "y", "id", trees=12, max_depth=6, seed=3)
    best = FT.from_ml(DecisionTreeRegressor(maxDepth=6).fit(assemble(df, COLS, "y")))
    drawn, chosen = ({float(x) for x in t.threshold[t.feature == 2]} for t in (model.trees, best))
    assert len(drawn) > 20 and len(drawn - chosen) > 10
    assert model.transform(df).agg(F.corr("y", "pred")).first()[0] > 0.97
    again = G.extra_trees(df.repartition(2), COLS, "y", "id", trees=12, max_depth=6, seed=3)
    assert np.array_equal(model.trees.feature, again.trees.feature) and np.allclose(model.trees.value, again.trees.value)


def test_nulls_few_rows_and_constants(spark):
    odd = spark.createDataFrame([(1, None, 1.0), (2, float("nan"), 1.0), (3, 0.0, 5.0), (4, 0.0, None)], "id int, a double, y double")
    for fit in (lambda d: G.boost(d, ["a"], "y", "id", rounds=2, step=1.0, max_depth=1), lambda d: G.extra_trees(d, ["a"], "y", "id", trees=2)):
        assert len(fit(odd).transform(odd).collect()) == 4
        none = odd.filter("id > 9")
        assert fit(none).transform(odd).filter("pred = 0").count() == 4


def test_rows_with_equal_bins_are_one_row(df, rows):
    many = df.select("a", "b", "y", "id", (F.col("fold") == 0).alias("judge")).unionByName(
        df.select("a", "b", "y", (F.col("id") + 900).alias("id"), (F.col("fold") == 0).alias("judge")))
    bins = G.find_bins(many, ["a", "b"])
    alike = G.binned(many, bins, "y", "id", F.col("judge"), alike=True)
    assert alike.count() == 20 and alike.agg(F.sum("w")).first()[0] == 1800  # 10 pairs of values, learning and judging
    one, two = (G.boost(d, ["a", "b"], "y", "id", rounds=6, step=0.5, max_depth=2, validation="judge", min_leaf=m)
                for d, m in ((many.filter("id < 900"), 1), (many, 2)))
    assert np.allclose(one.info["curve"], two.info["curve"]) and np.allclose(one.trees.value, two.trees.value)


def test_packed_rows_keep_every_row(df):
    bins = G.find_bins(df, COLS)
    packed = G.binned(df, bins, "y", "id")
    assert packed.count() < 900 / 20
    state = G._State([], 0.0, 1.0, 0)
    flat = G._Growth(bins, 1, 1, 1, 2, 1, False, 1.0).flat()
    sent = packed.sparkSession.sparkContext.broadcast((state, flat))
    got = sorted(r.r for r in packed.mapInArrow(G.partial(G._residuals, sent), "leaf int, r double").collect())
    assert np.allclose(got, sorted(r.y for r in df.collect()))


def test_bags_read_rows_that_repeat_once(df):
    twice = df.select("id", "a", "b", "y").unionByName(df.select("id", "a", "b", "y"))
    sums = T.bag_sums(twice, ["a", "b"], "y", "id", 2, 1)
    assert sums.count() == 10
    weighted = T.with_poisson_weight(twice, "id", 1, 1).filter("w > 0")
    want = T.tree(weighted, ["a", "b"], "y", 3, weight="w", seed=2)
    got = T.bagged_trees(twice, ["a", "b"], "y", "id", bags=2, max_depth=3).models[1]
    both = got.transform(want.transform(df, "want"), "got")
    assert both.agg(F.max(F.abs(F.col("want") - F.col("got")))).first()[0] < 1e-9


def test_adaboost_reads_rows_that_repeat_once(df, monkeypatch):
    twice, seen = df.select("id", *COLS, "y").unionByName(df.select("id", *COLS, "y")), []
    kept = T.durable
    monkeypatch.setattr(T, "durable", lambda d: seen.append(kept(d)) or seen[-1])
    got = T.adaboost_r2(twice, COLS, "y", "id", rounds=2, learning_rate=1.0)
    assert seen[0].count() == 900 and seen[0].agg(F.sum("w")).first()[0] == 1800
    want = T.adaboost_r2(df, COLS, "y", "id", rounds=2, learning_rate=1.0)
    assert np.allclose(got.weights, want.weights)


def plain_weighted(x, y, w, depth):
    """As plain_tree, rows counting by weight."""
    if depth and len(y) > 1:
        best = max(((sum((w[s] @ y[s]) ** 2 / w[s].sum() for s in (x[:, j] <= t, x[:, j] > t)), -j, -t)
                    for j in range(x.shape[1]) for t in np.unique(x[:, j])[:-1]), default=None)
        if best is not None and best[0] > (w @ y) ** 2 / w.sum() + 1e-9:
            j, t = -best[1], -best[2]
            s = x[:, j] <= t
            return j, t, plain_weighted(x[s], y[s], w[s], depth - 1), plain_weighted(x[~s], y[~s], w[~s], depth - 1)
    return float(w @ y / w.sum())


@pytest.mark.parametrize("way", ["one task", "sums per combination of bins", "a pass per level"])
def test_adaboost_equals_brute_force(df, rows, way, monkeypatch):
    if way != "one task":
        monkeypatch.setattr(G, "ROWS_IN_TASK", 0)
        monkeypatch.setattr(G, "FEW_CELLS", 100 if way.startswith("sums") else 0)
        monkeypatch.setattr(G, "FEW_TASKS", 0)
    x, y = np.array([r[1:3] for r in rows], float), np.array([r[4] for r in rows])
    model = T.adaboost_r2(df, ["a", "b"], "y", "id", rounds=7, learning_rate=0.5, max_depth=2, cut_every=3)
    w, preds, weights = np.ones(900), [], []
    for _ in range(7):
        tree = plain_weighted(x, y, w, 2)
        p = np.array([plain_score(tree, r) for r in x])
        e = np.abs(y - p) / np.abs(y - p).max()
        beta = (w @ e / w.sum()) / (1 - w @ e / w.sum())
        preds.append(p), weights.append(-0.5 * np.log(beta))
        w = w * beta ** ((1 - e) * 0.5)
    assert np.allclose(model.weights, weights)
    got = {r.id: r.pred for r in model.transform(df).collect()}
    assert np.allclose([got[i] for i in range(900)], FT.weighted_median(np.stack(preds, 1), np.array(weights)))


def test_adaboost_query_does_all_rounds(spark, df, monkeypatch):
    from broadloom.plans import q_model as Q

    seen, fit = [], T.adaboost_r2
    flags = df.select(F.col("id").alias("ID"), F.col("y").alias("y_lin"), *[(F.col("id") * (i + 3) % 7 > F.col("b")).cast("int").alias(c) for i, c in enumerate(Q.X)])
    monkeypatch.setattr(Q, "halves", lambda *_: (flags.filter("ID % 2 = 0"), flags.filter("ID % 2 = 1")))
    monkeypatch.setattr(T, "adaboost_r2", lambda *a, **k: seen.append(fit(*a, **k)) or seen[-1])
    assert Q.adaboost_r2(spark, "").first()["n"] == 450
    assert len(seen[0].models) == 300 and max(seen[0].weights) < 0.05  # steps of .01 times the log odds


def test_adaboost_edges(spark):
    odd = spark.createDataFrame([(1, 0.0, 1.0), (2, 1.0, 5.0), (3, None, 9.0), (4, float("nan"), 9.0)], "id int, a double, y double")
    model = T.adaboost_r2(odd, ["a"], "y", "id", rounds=5)
    assert len(model.models) == 1 and model.weights == [1.0]  # no error is left; rows without the column take no part
    assert [r.pred for r in model.transform(odd).orderBy("id").collect()] == [1.0, 5.0, 5.0, 5.0]
    for bad in (odd.filter("id > 9"), odd.unionByName(spark.createDataFrame([(5, 0.0, None)], odd.schema))):
        with pytest.raises(Exception):
            T.adaboost_r2(bad, ["a"], "y", "id", rounds=1)
