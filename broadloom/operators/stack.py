"""Out-of-fold prediction, the estimator registry, stacking chains and blends."""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from broadloom.operators import grower as Gr, linear as L, trees as T
from broadloom.operators.evaluate import fold_report
from broadloom.operators.gram import Gram, batch_matrix, gram
from broadloom.session import durable, side_by_side

# Learners read off the fold sums of one pass: name -> (gram of the training folds) -> linear model.
GRAM_LEARNERS = {
    "bayes_ridge": L.bayes_ridge,
    "enet": lambda g: L.from_gram(g, lambda m: L.enet_solve(m, 1.0, 0.5)),
    "enet_cv": L.enet_cv,
    "lasso": lambda g: L.from_gram(g, lambda m: L.enet_solve(m, 0.1, 1.0)),
    "lasso_cv": L.lasso_cv,
    "lasso_lars": lambda g: L.lars(g, 0.01),
    "lasso_lars_cv": L.lars_cv,
    "lasso_lars_ic": L.lars_ic,
    "ols": lambda g: L.from_gram(g, L.ols_solve),
    "omp": L.omp,
    "omp_cv": L.omp_cv,
    "ridge": lambda g: L.from_gram(g, lambda m: L.ridge_solve(m, 1.0)),
    "ridge_cv": L.ridge_cv,
    "kernel_ridge": lambda g: L.kernel_ridge_linear(g, 0.6),
}

# Those that choose a penalty or a size by the folds of their sums.
CHOOSERS = {"enet_cv", "lasso_cv", "lasso_lars_cv", "omp_cv", "ridge_cv"}
#: Folds that they choose by where the folds of the rows are left out two at a time.
PARTS = 5

# Learners that look at the rows: name -> (train, columns, target, key) -> model with transform(df, out).
ROW_LEARNERS = {
    "huber": lambda d, c, y, k: L.ml_linear(d, c, y, loss="huber", max_iter=100, tol=1e-6),
    "ransac": lambda d, c, y, k: L.ransac(d, c, y, k),
    "glm_ridge": lambda d, c, y, k: L.ml_linear(d, c, y, 0.1, 0.0),
    "glm_mixed": lambda d, c, y, k: L.ml_linear(d, c, y, 0.1, 0.5),
    "glm_lasso": lambda d, c, y, k: L.ml_linear(d, c, y, 0.1, 1.0),
    "tree": lambda d, c, y, k: T.tree(d, c, y),
    "forest": lambda d, c, y, k: T.forest(d, c, y, trees=20, max_depth=6),
    "gbt": lambda d, c, y, k: T.boosted(d, c, y, rounds=20),
    "extra_trees": lambda d, c, y, k: Gr.extra_trees(d, c, y, k, trees=10),
    "bagging": lambda d, c, y, k: T.bagged_trees(d, c, y, k, bags=10),
    "adaboost": lambda d, c, y, k: T.adaboost_r2(d, c, y, k, rounds=8, learning_rate=0.1),
}


def without_fold(g: Gram, fold: int) -> Gram:
    return g.without_fold(fold)


def fit_folds(train: DataFrame, cols, y: str, key: str, k: int, learner: str, fold: str = "fold", g: Gram | None = None):
    """One model per left-out fold. Linear learners drop the fold from the sums; the others refit."""
    if learner in GRAM_LEARNERS:
        g = g or gram(train, list(cols), y, fold)
        return [GRAM_LEARNERS[learner](without_fold(g, f)) for f in range(k)]
    return side_by_side([
        lambda f=f: ROW_LEARNERS[learner](train.filter(F.col(fold) != f), list(cols), y, key) for f in range(k)])


def _mean(names):
    return reduce(lambda a, b: a + b, map(F.col, names)) / F.lit(float(len(names)))


def score_folds(df: DataFrame, models, fold: str | None = None) -> DataFrame:
    """All fold models in one map: ``preds`` array, their mean, and the held-out one where folds are known."""
    if all(isinstance(m, L.Linear) for m in models):
        df = L.score_many(df, [*models, L.mean_model(models)], "__all")
        df = df.withColumn("preds", F.slice("__all", 1, len(models))) \
               .withColumn("mean_pred", F.element_at("__all", -1)).drop("__all")
    else:
        names = [f"__p{i}" for i in range(len(models))]
        if all(isinstance(m, T.TreeModel) and m.cols == models[0].cols for m in models):
            df = T.predict_many(models, df, names)
        else:
            for n, m in zip(names, models):
                df = m.transform(df, n)
        df = df.withColumn("preds", F.array(*names)).withColumn("mean_pred", _mean(names)).drop(*names)
    return df.withColumn("oof_pred", F.element_at("preds", F.col(fold) + 1)) if fold else df


def score_all(df: DataFrame, fitted: dict, keep, fold: str | None = None) -> DataFrame:
    """Every fold model of every learner over one scan, unfolded to one row per learner.

    The linear models of all learners are one matrix product per batch."""
    linear = {n: ms for n, ms in fitted.items() if all(isinstance(m, L.Linear) for m in ms)}
    parts, at = [], 1
    if linear:
        df = L.score_many(df, [m for ms in linear.values() for m in (*ms, L.mean_model(ms))], "__all")
        for n, ms in linear.items():
            parts.append(F.struct(F.lit(n).alias("model"), F.slice("__all", at, len(ms)).alias("preds"),
                                  F.element_at("__all", at + len(ms)).alias("mean_pred")))
            at += len(ms) + 1
    for n, ms in fitted.items():
        if n not in linear:
            df = score_folds(df, ms).withColumn(f"__{n}", F.struct(F.lit(n).alias("model"), "preds", "mean_pred")) \
                                    .drop("preds", "mean_pred")
            parts.append(F.col(f"__{n}"))
    out = df.select(*keep, F.explode(F.array(*parts)).alias("__s"))
    out = out.select(*out.columns[:-1], "__s.*")
    return out.withColumn("oof_pred", F.element_at("preds", F.col(fold) + 1)) if fold else out


def fold_scores(scored: DataFrame, y: str = "y", fold: str = "fold", by: str = "model") -> DataFrame:
    """Per learner: mean held-out R2 of the folds, pooled out-of-fold R2, and mean R2 on the rows each fold
    model was fitted on. One pass sums (fold x fold model) cells; the rest works on those few rows."""
    long = scored.select(by, F.col(y).cast("double").alias("__y"), F.col(fold).alias("__f"),
                         F.posexplode("preds").alias("__m", "__p"))
    e = F.col("__y") - F.col("__p")
    return _cell_scores(long.groupBy(by, "__f", "__m").agg(
        F.count(e).alias("n"), F.sum(e * e).alias("sse"), F.avg("__y").alias("a"), F.var_pop("__y").alias("v")), by)


def _cells(matrix, base, names, k, shift, batches):
    """(model, __f, __m, n, sse, ny, s, q) of a task: every linear model on every fold, one product per batch."""
    acc: dict = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        y, fold = batch.column("y"), batch.column("fold").to_numpy(zero_copy_only=False)
        there, y = ~np.asarray(y.is_null()), y.to_numpy(zero_copy_only=False)
        z = batch_matrix(batch.column("x"), len(matrix)) @ matrix + base
        ok, e = there[:, None] & ~np.isnan(z), y[:, None] - z
        for f in np.unique(fold):
            mine = fold == f
            off = y[mine & there] - shift
            sums = acc.setdefault(int(f), [np.zeros(len(base)), np.zeros(len(base)), np.zeros(3)])
            sums[0] += ok[mine].sum(0)
            sums[1] += np.where(ok[mine], e[mine] ** 2, 0.0).sum(0)
            sums[2] += (len(off), off.sum(), (off * off).sum())
    for f, (n, sse, own) in acc.items():
        wide = len(base)
        yield pa.record_batch([pa.array(np.repeat(names, k)), pa.array(np.full(wide, f, np.int32)), pa.array(np.tile(np.arange(k, dtype=np.int32), len(names))),
                               pa.array(n), pa.array(sse), *[pa.array(np.full(wide, v)) for v in own]], names=["model", "__f", "__m", "n", "sse", "ny", "s", "q"])


def linear_scores(df: DataFrame, fitted: dict, y: str, fold: str, shift: float = 0.0) -> DataFrame:
    """``fold_scores`` of linear fold models from one pass over the rows, none of which is repeated per model and fold.
    ``shift``: a value amid the target."""
    models = [m for ms in fitted.values() for m in ms]
    cols = sorted({n for m in models for n in m.names})
    maps = [dict(zip(m.names, m.coef)) for m in models]
    matrix = np.array([[b.get(n, 0.0) for b in maps] for n in cols], float).reshape(len(cols), len(models))
    base = np.array([m.intercept for m in models], float)
    rows = df.filter(F.col(fold).isNotNull()).select(F.array(*[F.col(c).cast("double") for c in cols]).cast("array<double>").alias("x"),
                                                     F.col(y).cast("double").alias("y"), F.col(fold).cast("int").alias("fold"))
    k = len(next(iter(fitted.values())))
    parts = rows.mapInArrow(partial(_cells, matrix, base, list(fitted), k, shift),
                            "model string, __f int, __m int, n double, sse double, ny double, s double, q double")
    sums = parts.groupBy("model", "__f", "__m").agg(*[F.sum(c).alias(c) for c in ("n", "sse", "ny", "s", "q")])
    mean = F.try_divide("s", "ny")
    return _cell_scores(sums.select("model", "__f", "__m", F.col("n").cast("bigint").alias("n"), F.when(F.col("n") > 0, F.col("sse")).alias("sse"), (mean + F.lit(shift)).alias("a"),
                                    (F.try_divide("q", "ny") - mean * mean).alias("v")), "model")


def _cell_scores(cells: DataFrame, by: str) -> DataFrame:
    """The report from count, squared error, mean and variance of the target per (learner, fold, fold model)."""
    def r2(cond):
        n = F.sum(F.when(cond, F.col("n")))
        mean = F.sum(F.when(cond, F.col("n") * F.col("a"))) / n
        sst = F.sum(F.when(cond, F.col("n") * (F.col("v") + F.col("a") * F.col("a")))) - n * mean * mean
        return 1 - F.try_divide(F.sum(F.when(cond, F.col("sse"))), sst)

    own = F.col("__m") == F.col("__f")
    per = cells.groupBy(by, "__m").agg(
        r2(~own).alias("infold"), r2(own).alias("held"),
        *[F.max(F.when(own, F.col(c))).alias(c) for c in ("n", "sse", "a", "v")])
    total = F.sum("n")
    mean = F.sum(F.col("n") * F.col("a")) / total
    sst = F.sum(F.col("n") * (F.col("v") + F.col("a") * F.col("a"))) - total * mean * mean
    return per.groupBy(by).agg(
        F.avg("held").alias("fold_r2"), (1 - F.try_divide(F.sum("sse"), sst)).alias("oof_r2"),
        F.avg("infold").alias("infold_r2"), total.alias("n"))


def run_registry(train: DataFrame, test: DataFrame, cols, y: str, key: str, k: int, learners, fold: str = "fold"):
    """The same out-of-fold job for every named learner.

    Returns (train predictions, test predictions, metrics): long tables with a ``model`` column. All linear
    learners share a single pass over the training rows, and all learners share one scoring scan.
    """
    fitted = fit_registry(train, cols, y, key, k, learners, fold)
    scored = score_all(train, fitted, [key, fold, F.col(y).alias("y")], fold)
    if all(isinstance(m, L.Linear) for ms in fitted.values() for m in ms):
        shift = train.agg(F.avg(F.col(y).cast("double"))).first()[0] or 0.0
        mean = score_all(test, {n: [L.mean_model(ms)] for n, ms in fitted.items()}, [key])
        return scored.drop("preds"), mean.select(key, "model", F.col("mean_pred").alias("pred")), linear_scores(train, fitted, y, fold, shift)
    test_scored = score_all(test, fitted, [key]).select(key, "model", F.col("mean_pred").alias("pred"))
    return scored.drop("preds"), test_scored, fold_scores(scored, "y", fold)


def fit_registry(train: DataFrame, cols, y: str, key: str, k: int, learners, fold: str = "fold") -> dict:
    cols = list(cols)
    g = gram(train, cols, y, fold) if any(n in GRAM_LEARNERS for n in learners) else None
    rows = [n for n in learners if n not in GRAM_LEARNERS]
    source = durable(train.select(key, fold, y, *cols)) if rows else train  # read again by every fit
    return {n: fit_folds(source, cols, y, key, k, n, fold, g) for n in learners}


class PredictionFeature(Estimator):
    """Stacking step: fit an estimator, then put its prediction (and class probabilities, if it has any)
    in front of the feature vector."""

    def __init__(self, estimator, featuresCol: str = "features"):
        super().__init__()
        self.estimator, self.featuresCol = estimator, featuresCol

    def _fit(self, dataset: DataFrame) -> "PredictionFeatureModel":
        return PredictionFeatureModel(self.estimator.fit(dataset), self.featuresCol)


class PredictionFeatureModel(Model):
    def __init__(self, model, featuresCol: str):
        super().__init__()
        self.model, self.featuresCol = model, featuresCol

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scored = self.model.transform(dataset)
        added = [c for c in ("prediction", "probability") if c in scored.columns]
        out = VectorAssembler(inputCols=[*added, self.featuresCol], outputCol="__f").transform(scored)
        return out.select(*[c for c in dataset.columns if c != self.featuresCol], F.col("__f").alias(self.featuresCol))


def layer1_matrix(long: DataFrame, models: list[str], key: str = "ID", value: str = "pred") -> DataFrame:
    """One row per key, one column per model, only keys every model has predicted."""
    return long.groupBy(key).pivot("model", models).agg(F.first(value)).na.drop(subset=models)


def blend(matrix: DataFrame, weights: dict[str, float], out: str = "y") -> DataFrame:
    """Weighted sum of prediction columns; the weights must add up to one."""
    if abs(sum(weights.values()) - 1.0) > 1e-9:
        raise ValueError(f"blend weights add up to {sum(weights.values())}, not 1")
    return matrix.withColumn(out, reduce(lambda a, b: a + b, [F.lit(float(w)) * F.col(c) for c, w in weights.items()]))


def super_learner(train: DataFrame, test: DataFrame, cols, y: str, key: str, k: int, bases, meta: str = "ols",
                  fold: str = "fold"):
    """Cross-validated base predictions become the features of a meta learner; scoring stays a map.

    Returns (train scored, test scored, meta model)."""
    bases = list(bases)
    level1, level1_test = train.withColumn("__y", F.col(y)), test
    for n, models in fit_registry(train, cols, y, key, k, bases, fold).items():
        level1 = score_folds(level1, models, fold).withColumnRenamed("oof_pred", f"base_{n}").drop("preds", "mean_pred")
        level1_test = score_folds(level1_test, models).withColumnRenamed("mean_pred", f"base_{n}").drop("preds")
    names = [f"base_{n}" for n in bases]
    level1 = level1.select(key, fold, F.col("__y").alias("y"), *names)
    level1_test = level1_test.select(key, *names)
    if meta in GRAM_LEARNERS:
        model = GRAM_LEARNERS[meta](gram(level1, names, "y", fold))
    else:
        model = ROW_LEARNERS[meta](level1, names, "y", key)
    return model.transform(level1, "pred"), model.transform(level1_test, "pred"), model


# ---- two layers -----------------------------------------------------------------------------------------------

def _all_predictions(df: DataFrame, models: list, out: str = "__all") -> DataFrame:
    """One array of the models' predictions; linear ones are one matrix product."""
    linear = [m for m in models if isinstance(m, L.Linear)]
    if len(linear) == len(models):
        return L.score_many(df, models, out)
    names, others = [f"__m{i}" for i in range(len(models))], [(i, m) for i, m in enumerate(models) if not isinstance(m, L.Linear)]
    if linear:
        df = L.score_many(df, linear, "__linear")
    if all(isinstance(m, T.TreeModel) and m.cols == others[0][1].cols for _, m in others):
        df = T.predict_many([m for _, m in others], df, [names[i] for i, _ in others])
    else:
        for i, m in others:
            df = m.transform(df, names[i])
    at = iter(range(1, len(linear) + 1))
    each = [F.element_at("__linear", next(at)) if isinstance(m, L.Linear) else F.col(n) for n, m in zip(names, models)]
    return df.withColumn(out, F.array(*each)).drop("__linear", *names)


def part_of(cols):
    """Number of a row's part, by a hash of its values: rows whose key is missing or repeats are spread as well."""
    return F.pmod(F.xxhash64(*cols), F.lit(PARTS)).cast("int")


def _fit_pairs(train: DataFrame, y: str, key: str, k: int, bases: dict, fold: str) -> dict:
    """Base models by (base, folds left out), one or two of them. Linear ones come from the fold sums of one pass.

    Learners that choose by folds choose by PARTS parts of the rows they learn from, whatever is left out: of the folds
    themselves too few may be left to choose by, of three a single one."""
    out = [(f,) for f in range(k)] + [(f, j) for f in range(k) for j in range(f + 1, k)]
    sums = {n: cols for n, (learner, cols) in bases.items() if learner in GRAM_LEARNERS}
    every = sorted({c for cols in sums.values() for c in cols})
    choosing = any(learner in CHOOSERS for learner, _ in bases.values())
    g = gram(train.withColumn("__cell", F.col(fold) * PARTS + part_of([key, *every, y])) if choosing else train, every, y, "__cell" if choosing else fold) if sums else None

    def kept(part, learner, left):
        """Sums without the folds ``left``: by parts of the rows for those that choose, else by fold."""
        if not choosing:
            return part.take_folds({f: f for f in range(k) if f not in left})
        part = part.take_folds({c: c for c in range(k * PARTS) if c // PARTS not in left})
        return part.merge(lambda c: c % PARTS if learner in CHOOSERS else c // PARTS)

    fitted, jobs = {}, []
    for n, (learner, cols) in bases.items():
        for left in out:
            if learner in GRAM_LEARNERS:
                part = g.pick(list(cols), y)
                fitted[n, left] = GRAM_LEARNERS[learner](kept(part, learner, left))
            else:
                jobs.append(((n, left), lambda learner=learner, cols=cols, left=left: ROW_LEARNERS[learner](
                    train.filter(~F.col(fold).isin(list(left))), list(cols), y, key)))
    fitted.update(zip([j[0] for j in jobs], side_by_side([j[1] for j in jobs])))
    return fitted


def nested_registry(train: DataFrame, test: DataFrame, y: str, key: str, k: int, bases: dict, metas: list[str], fold: str = "fold"):
    """Layer-2 learners out of fold on the predictions of layer-1 learners, neither of which has seen the row.

    ``bases`` maps a name to (learner, columns). For outer fold f the layer-2 training rows get the predictions of base
    models that left out f and the row's own fold, the held-out rows those of models that left out f: all these models come
    from one pass of fold sums (learners that look at rows are refitted) and score in one scan; each chooses its penalty or
    size by parts of the rows it learns from. The layer-2 models of
    all linear learners come from one more pass over the written matrix. A test row gets the mean over the outer folds.

    Returns (out-of-fold predictions: key, fold, y, model, pred; test predictions: key, model, pred; scores per model).
    """
    fitted = _fit_pairs(train, y, key, k, bases, fold)
    wanted = list(fitted)
    place = {name: i + 1 for i, name in enumerate(wanted)}
    names = [f"base_{n}" for n in bases]

    def features(outer, own):
        """A row's base predictions for an outer fold; ``own`` is its fold, None for test rows."""
        out = []
        for n in bases:
            at = [place[n, tuple(sorted({outer, j}))] for j in range(k)]
            spot = F.lit(place[n, (outer,)]) if own is None else F.element_at(F.array(*[F.lit(a) for a in at]), own + 1)
            out.append(F.element_at("__all", spot).alias(f"base_{n}"))
        return out

    own = F.col(fold).cast("int")
    rows = [F.struct(F.lit(f).alias("outer"), *features(f, own)) for f in range(k)]
    matrix = _all_predictions(train, [fitted[w] for w in wanted]).select(
        key, own.alias("fold"), F.col(y).cast("double").alias("y"), F.explode(F.array(*rows)).alias("r")).select(key, "fold", "y", "r.*")
    matrix = durable(matrix)
    learn, held = matrix.filter("outer <> fold"), matrix.filter("outer = fold")

    models = {}
    linear = [m for m in metas if m in GRAM_LEARNERS]
    if linear:
        g = gram(learn.withColumn("cell", F.col("outer") * k + F.col("fold")), names, "y", "cell")
        for m in linear:
            models[m] = [GRAM_LEARNERS[m](g.take_folds({j: f * k + j for j in range(k) if j != f})) for f in range(k)]
    for m in (m for m in metas if m not in GRAM_LEARNERS):
        models[m] = side_by_side([lambda f=f, m=m: ROW_LEARNERS[m](learn.filter(F.col("outer") == f), names, "y", key) for f in range(k)])

    def scored(df, keep):
        parts = []
        if linear:
            every = [x for m in linear for x in models[m]]
            one = _all_predictions(df, every)
            picks = [F.struct(F.lit(m).alias("model"), F.element_at("__all", F.col("outer") + 1 + i * k).alias("pred")) for i, m in enumerate(linear)]
            parts.append(one.select(*keep, F.explode(F.array(*picks)).alias("p")).select(*keep, "p.*"))
        for m in metas:
            if m not in GRAM_LEARNERS:
                parts += [models[m][f].transform(df.filter(F.col("outer") == f), "pred").select(*keep, F.lit(m).alias("model"), "pred") for f in range(k)]
        return reduce(DataFrame.unionByName, parts)

    oof = scored(held, [key, "fold", "y"])
    # A test row keeps its scores of all outer folds beside each other: rows are neither multiplied nor read once per model.
    probe = _all_predictions(test, [fitted[w] for w in wanted]).select(key, *[F.struct(*features(f, None)).alias(f"__r{f}") for f in range(k)])
    for f in range(k):
        probe = probe.select(*[c for c in probe.columns if c not in names], f"__r{f}.*")
        if linear:
            probe = _all_predictions(probe, [models[m][f] for m in linear], f"__l{f}")
        for i, m in enumerate(metas):
            if m not in GRAM_LEARNERS:
                probe = models[m][f].transform(probe, f"__p{i}_{f}")
    score = lambda i, m, f: F.element_at(f"__l{f}", linear.index(m) + 1) if m in linear else F.col(f"__p{i}_{f}")
    probe = probe.select(key, *[F.array(*[score(i, m, f) for f in range(k)]).alias(f"__p{i}") for i, m in enumerate(metas)])
    there = [F.filter(f"__p{i}", lambda p: p.isNotNull()) for i in range(len(metas))]
    sums = [F.aggregate(t, F.lit(0.0), lambda a, p: a + p) for t in there]
    probe = probe.groupBy(key).agg(*[F.sum(s).alias(f"s{i}") for i, s in enumerate(sums)], *[F.sum(F.size(t)).alias(f"n{i}") for i, t in enumerate(there)])
    preds = probe.select(key, F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.try_divide(f"s{i}", f"n{i}").alias("pred")) for i, m in enumerate(metas)])).alias("p")).select(key, "p.*")
    return oof, preds, fold_report(oof, "y", "pred", "fold", ("model",))
