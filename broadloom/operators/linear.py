"""Linear regression jobs.

Single fits use Spark ML. Everything that needs many fits of one table (penalty grids, k-fold choices,
greedy paths, leave-one-out) is read off the fold cross products of one Gram pass: the work on the rows is
one aggregate, the rest is p x p.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import DataFrame, Window as W, functions as F

from broadloom.functions.columns import HASH_SPAN, hash52, linear_score
from broadloom.operators.gram import Gram, Moments, batch_matrix, gram, gram_array, sum_batches
from broadloom.operators.ordering import exact_quantiles
from broadloom.session import durable

RIDGE_GRID = (0.1, 1.0, 10.0)


@dataclass
class Linear:
    """Coefficients and intercept, and what was chosen on the way."""
    names: list[str]
    coef: np.ndarray
    intercept: float
    info: dict = field(default_factory=dict)

    def score(self):
        return linear_score(self.names, self.coef, self.intercept)

    def transform(self, df: DataFrame, out: str = "pred") -> DataFrame:
        return df.withColumn(out, self.score())

    def table(self, spark) -> DataFrame:
        rows = [("(intercept)", float(self.intercept))] + [(n, float(b)) for n, b in zip(self.names, self.coef)]
        return spark.createDataFrame(rows, "term string, coef double")


def _with_intercept(m: Moments, coef) -> tuple[np.ndarray, float]:
    coef = np.asarray(coef, float)
    return coef, float(m.y_mean - m.mean @ coef)


# ---- solvers on centred moments -------------------------------------------------------------------------

def ols_solve(m: Moments) -> np.ndarray:
    return np.linalg.lstsq(m.sxx, m.sxy, rcond=None)[0]


def ridge_solve(m: Moments, alpha: float) -> np.ndarray:
    return np.linalg.solve(m.sxx + alpha * np.eye(len(m.sxy)), m.sxy)


def enet_solve(m: Moments, alpha: float, l1_ratio: float, tol: float = 1e-10, sweeps: int = 5_000,
               start: np.ndarray | None = None) -> np.ndarray:
    """Minimise SSE / 2n + alpha (l1_ratio |w|_1 + (1 - l1_ratio) |w|^2 / 2) by cyclic descent."""
    return _descend(m.sxx / m.n, m.sxy / m.n, np.sqrt(m.syy / m.n), alpha * l1_ratio, alpha * (1 - l1_ratio), tol, sweeps, start)[0]


def _descend(q, c, scale, l1, l2, tol, sweeps, start=None) -> tuple[np.ndarray, bool]:
    """Coordinate descent with the gradient kept up to date, on the active columns until they settle and then once over
    all whose optimality condition fails. Returns the weights and whether they converged."""
    p = len(c)
    w = np.zeros(p) if start is None else start.copy()
    diag = np.diag(q).copy()
    usable = diag > 0
    grad = c - q @ w
    root, bound = np.sqrt(np.maximum(diag, 0)), tol * max(1.0, scale)
    active = np.flatnonzero(w).tolist()
    for _ in range(sweeps):
        shift = 0.0
        for j in active:
            old = w[j]
            rho = grad[j] + diag[j] * old
            new = (rho - l1 if rho > l1 else rho + l1 if rho < -l1 else 0.0) / (diag[j] + l2)
            if new != old:
                grad -= q[j] * (new - old)
                w[j] = new
                shift = max(shift, abs(new - old) * root[j])
        if shift > bound:
            continue
        wrong = np.flatnonzero(usable & (w == 0) & (np.abs(grad) > l1 + bound * np.maximum(root, 1e-300)))
        active = sorted(set(np.flatnonzero(w).tolist()) | set(wrong.tolist()))
        if not len(wrong):
            return w, True
    return w, False


def alpha_grid(m: Moments, l1_ratio: float, points: int, eps: float = 1e-3) -> np.ndarray:
    top = np.max(np.abs(m.sxy)) / m.n / l1_ratio
    return np.geomspace(top, top * eps, points)


def omp_solve(m: Moments, atoms: int) -> np.ndarray:
    """Greedy: add the column most correlated with the residual, refit on the chosen columns."""
    norm = np.sqrt(np.maximum(np.diag(m.sxx), 1e-300))
    chosen: list[int] = []
    w = np.zeros(len(m.sxy))
    for _ in range(min(atoms, len(w))):
        r = np.abs(m.sxy - m.sxx @ w) / norm
        r[chosen] = -1.0
        chosen.append(int(np.argmax(r)))
        w = np.zeros(len(m.sxy))
        w[chosen] = np.linalg.lstsq(m.sxx[np.ix_(chosen, chosen)], m.sxy[chosen], rcond=None)[0]
    return w


def lasso_path(m: Moments) -> list[tuple[float, np.ndarray]]:
    """Knots (alpha, coefficients) of the least-angle lasso path, from the largest alpha down to zero."""
    q, c, p = m.sxx / m.n, m.sxy / m.n, len(m.sxy)
    w = np.zeros(p)
    lam = float(np.max(np.abs(c)))
    knots = [(lam, w.copy())]
    active = [int(np.argmax(np.abs(c)))]
    for _ in range(8 * p):
        r = c - q @ w
        s = np.sign(r[active])
        d = np.zeros(p)
        d[active] = np.linalg.lstsq(q[np.ix_(active, active)], s, rcond=None)[0]
        qd = q @ d
        step, enter, leave = lam, None, None
        for j in range(p):
            if j in active:
                if d[j] * w[j] < 0 and 1e-12 < -w[j] / d[j] < step:
                    step, enter, leave = -w[j] / d[j], None, j
                continue
            for top, bottom in ((lam - r[j], 1 - qd[j]), (lam + r[j], 1 + qd[j])):
                if bottom > 1e-12 and 1e-12 < top / bottom < step:
                    step, enter, leave = top / bottom, j, None
        w = w + step * d
        lam -= step
        if leave is not None:
            w[leave] = 0.0
            active.remove(leave)
        knots.append((max(lam, 0.0), w.copy()))
        if enter is not None:
            active.append(enter)
        if lam <= 1e-12 or (enter is None and leave is None) or not active:
            break
    return knots


def path_at(knots, alpha: float) -> np.ndarray:
    if alpha >= knots[0][0]:
        return knots[0][1]
    for (a0, w0), (a1, w1) in zip(knots, knots[1:]):
        if a1 <= alpha <= a0:
            t = (a0 - alpha) / (a0 - a1) if a0 > a1 else 1.0
            return w0 + t * (w1 - w0)
    return knots[-1][1]


def bayes_solve(m: Moments, steps: int = 300, tol: float = 1e-3, hyper: float = 1e-6):
    """Evidence iteration over noise and weight precision on the eigenvalues of X'X."""
    ev, v = np.linalg.eigh(m.sxx)
    ev = np.maximum(ev, 0.0)
    z = v.T @ m.sxy
    noise, weight, old = 1.0 / max(m.syy / m.n, 1e-300), 1.0, None
    for _ in range(steps):
        coef = v @ (z / (ev + weight / noise))
        rss = max(m.syy - 2 * coef @ m.sxy + coef @ m.sxx @ coef, 0.0)
        gamma = float(np.sum(noise * ev / (weight + noise * ev)))
        weight = (gamma + 2 * hyper) / (coef @ coef + 2 * hyper)
        noise = (m.n - gamma + 2 * hyper) / (rss + 2 * hyper)
        if old is not None and np.sum(np.abs(coef - old)) < tol:
            break
        old = coef
    return v @ (z / (ev + weight / noise)), noise, weight


def pls_solve(m: Moments, comps: int) -> np.ndarray:
    """Single-target partial least squares by deflating the cross products."""
    s, c = m.sxx.copy(), m.sxy.copy()
    ws, ps, qs = [], [], []
    for _ in range(min(comps, len(c))):
        norm = np.linalg.norm(c)
        if norm < 1e-10 * max(np.linalg.norm(m.sxy), 1e-300):
            break
        w = c / norm
        tt = w @ s @ w
        if tt <= 1e-12:
            break
        p, q = s @ w / tt, c @ w / tt
        s = s - tt * np.outer(p, p)
        c = c - tt * q * p
        ws.append(w), ps.append(p), qs.append(q)
    w, p = np.array(ws).T, np.array(ps).T
    return w @ np.linalg.solve(p.T @ w, np.array(qs))


def pcr_solve(m: Moments, comps: int, scale: bool = False) -> np.ndarray:
    """Regression on the leading principal components, expressed in the original columns."""
    sd = np.sqrt(np.maximum(np.diag(m.sxx) / (m.n - 1), 1e-300)) if scale else np.ones(len(m.sxy))
    ev, v = np.linalg.eigh(m.sxx / np.outer(sd, sd))
    order = np.argsort(-ev)[:comps]
    order = order[ev[order] > 1e-10 * max(ev.max(), 1e-300)]
    v = v[:, order]
    return (v @ ((v.T @ (m.sxy / sd)) / ev[order])) / sd


# ---- choices by k-fold, without another look at the rows -----------------------------------------------------

def cv_curve(g: Gram, path) -> np.ndarray:
    """Mean squared error over folds of every coefficient vector of ``path(moments)``."""
    total = 0.0
    for k in g.folds:
        m = g.moments(without=k)
        total = total + np.array([g.sse(k, *_with_intercept(m, w)) for w in path(m)]) / g.folds[k][0]
    return total / len(g.folds)


def _choose(g: Gram, grid, path, label: str) -> Linear:
    if len(g.folds) < 2:
        warnings.warn(f"{len(g.folds)} folds: nothing to choose {label} by, the first one is taken", RuntimeWarning, stacklevel=3)
    mse = cv_curve(g, path)
    best = int(np.argmin(mse))
    m = g.moments()
    coef, b0 = _with_intercept(m, path(m)[best])
    return Linear(g.names[:-1], coef, b0, {label: float(grid[best]), "mse": float(mse[best])})


def ridge_cv(g: Gram, grid=RIDGE_GRID) -> Linear:
    return _choose(g, grid, lambda m: [ridge_solve(m, a) for a in grid], "alpha")


def enet_path(m: Moments, grid, l1_ratio: float) -> list[np.ndarray]:
    """Falling penalties, each started from the solution before it. Warns if one of them did not converge."""
    out, w, q, c, scale = [], None, m.sxx / m.n, m.sxy / m.n, np.sqrt(m.syy / m.n)
    for a in grid:
        w, settled = _descend(q, c, scale, a * l1_ratio, a * (1 - l1_ratio), 1e-7, 10_000, w)
        if not settled:
            warnings.warn(f"no convergence at penalty {a:.3g}", RuntimeWarning, stacklevel=2)
        out.append(w)
    return out


def lasso_cv(g: Gram, points: int = 100, l1_ratio: float = 1.0) -> Linear:
    grid = alpha_grid(g.moments(), l1_ratio, points)
    return _choose(g, grid, lambda m: enet_path(m, grid, l1_ratio), "alpha")


def enet_cv(g: Gram, points: int = 100, l1_ratio: float = 0.5) -> Linear:
    return lasso_cv(g, points, l1_ratio)


def lars_cv(g: Gram) -> Linear:
    """Alpha among the knots of the full path, each fold following its own path."""
    alphas = [a for a, _ in lasso_path(g.moments())]

    def path(m):
        knots = lasso_path(m)
        return [path_at(knots, a) for a in alphas]

    return _choose(g, alphas, path, "alpha")


def omp_cv(g: Gram, max_atoms: int | None = None) -> Linear:
    p = len(g.names) - 1
    sizes = range(1, (max_atoms or min(max(p // 10, 5), p)) + 1)
    return _choose(g, sizes, lambda m: [omp_solve(m, k) for k in sizes], "atoms")


def pls_cv(g: Gram, max_comps: int = 20) -> Linear:
    sizes = range(1, min(max_comps, len(g.names) - 1) + 1)
    return _choose(g, sizes, lambda m: [pls_solve(m, k) for k in sizes], "comps")


def pcr_cv(g: Gram, max_comps: int = 40) -> Linear:
    sizes = range(1, min(max_comps, len(g.names) - 1) + 1)
    return _choose(g, sizes, lambda m: [pcr_solve(m, k) for k in sizes], "comps")


# ---- single models from the Gram pass ------------------------------------------------------------------------

def from_gram(g: Gram, fit, without: int | None = None, **info) -> Linear:
    m = g.moments(without=without)
    coef, b0 = _with_intercept(m, fit(m))
    return Linear(g.names[:-1], coef, b0, info)


def kernel_ridge_linear(g: Gram, alpha: float = 0.6, without: int | None = None) -> Linear:
    """Linear-kernel ridge is ridge through the origin."""
    m = g.moments(without=without)
    return Linear(g.names[:-1], np.linalg.solve(m.raw_xx + alpha * np.eye(len(m.raw_xy)), m.raw_xy), 0.0)


def lars(g: Gram, alpha: float = 0.01) -> Linear:
    return from_gram(g, lambda m: path_at(lasso_path(m), alpha), alpha=alpha)


def lars_ic(g: Gram, criterion: str = "aic") -> Linear:
    """Knot of the path with the smallest information criterion."""
    m = g.moments()
    scores = []
    knots = lasso_path(m)
    noise = max(m.syy - m.sxy @ ols_solve(m), 1e-300) / max(m.n - len(m.sxy) - 1, 1)
    weight = 2.0 if criterion == "aic" else float(np.log(m.n))
    for _, w in knots:
        rss = m.syy - 2 * w @ m.sxy + w @ m.sxx @ w
        scores.append(rss / noise + weight * int(np.sum(np.abs(w) > 1e-12)))
    a, w = knots[int(np.argmin(scores))]
    coef, b0 = _with_intercept(m, w)
    return Linear(g.names[:-1], coef, b0, {"alpha": a})


def omp(g: Gram, atoms: int | None = None) -> Linear:
    k = atoms or max(int(0.1 * (len(g.names) - 1)), 1)
    return from_gram(g, lambda m: omp_solve(m, k), atoms=k)


def bayes_ridge(g: Gram) -> Linear:
    noise_weight = {}

    def fit(m):
        coef, noise_weight["noise"], noise_weight["weight"] = bayes_solve(m)
        return coef

    out = from_gram(g, fit)
    out.info.update(noise_weight)
    return out


def pls(g: Gram, comps: int) -> Linear:
    return from_gram(g, lambda m: pls_solve(m, comps), comps=comps)


def pcr(g: Gram, comps: int) -> Linear:
    return from_gram(g, lambda m: pcr_solve(m, comps), comps=comps)


def press(df: DataFrame, g: Gram, y: str) -> DataFrame:
    """Leave-one-out prediction of OLS for every row: y - e / (1 - h), no refit and no shuffle."""
    m = g.moments()
    model = from_gram(g, ols_solve)
    inv, mean, p, n = np.linalg.pinv(m.sxx), m.mean, len(model.names), m.n

    @F.arrow_udf("double")
    def leverage(x: pa.Array) -> pa.Array:
        d = batch_matrix(x, p) - mean
        return pa.array(1.0 / n + np.einsum("ij,ij->i", d @ inv, d), from_pandas=True)

    e = F.col(y) - model.score()
    h = leverage(F.array(*[F.col(c).cast("double") for c in model.names]))
    return df.withColumn("leverage", h).withColumn("loo_pred", F.col(y) - F.try_divide(e, 1 - F.col("leverage")))


# ---- Spark ML fits -------------------------------------------------------------------------------------------

def assemble(df: DataFrame, cols: list[str], y: str | None = None) -> DataFrame:
    out = VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="skip").transform(df)
    return out.withColumn("label", F.col(y).cast("double")) if y else out


def ml_linear(df: DataFrame, cols: list[str], y: str, alpha: float = 0.0, l1_ratio: float = 0.0,
              loss: str = "squaredError", epsilon: float = 1.35, max_iter: int = 500, tol: float = 1e-10) -> Linear:
    """OLS, ridge, lasso, elastic net (penalty alpha (l1_ratio |w|_1 + (1 - l1_ratio) |w|^2 / 2) on SSE / 2n)
    or Huber loss. Spark scales the squared penalty by the label's spread; that is undone here."""
    data = assemble(df, cols, y).select("features", "label")
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
    sd = data.agg(F.stddev_samp("label")).first()[0] or 1.0 if l2 and loss == "squaredError" else 1.0
    reg = l1 + sd * l2
    lr = LinearRegression(
        regParam=reg, elasticNetParam=(l1 / reg if reg else 0.0), standardization=False, loss=loss,
        maxIter=max_iter, tol=tol, solver="l-bfgs" if reg or loss == "huber" else "auto",
        **({"epsilon": epsilon} if loss == "huber" else {}))
    model = lr.fit(data)
    return Linear(list(cols), model.coefficients.toArray(), float(model.intercept))


def mean_model(models: list[Linear]) -> Linear:
    """The average of linear models is linear."""
    names = sorted({n for m in models for n in m.names})
    coef = np.mean([[dict(zip(m.names, m.coef)).get(n, 0.0) for n in names] for m in models], axis=0)
    return Linear(names, coef, float(np.mean([m.intercept for m in models])))


def score_many(df: DataFrame, models: list[Linear], out: str) -> DataFrame:
    """Array of the predictions of many linear models: one matrix product per Arrow batch."""
    names = sorted({n for m in models for n in m.names})
    maps = [dict(zip(m.names, m.coef)) for m in models]
    matrix = np.array([[b.get(n, 0.0) for b in maps] for n in names], dtype=float)
    base = np.array([m.intercept for m in models], dtype=float)
    p, k = matrix.shape

    @F.arrow_udf("array<double>")
    def score(x: pa.Array) -> pa.Array:
        z = batch_matrix(x, p) @ matrix + base
        offsets = pa.array(np.arange(0, (len(z) + 1) * k, k, dtype=np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(z.ravel(), from_pandas=True))

    return df.withColumn(out, score(F.array(*[F.col(n).cast("double") for n in names])))


def glm_terms(df: DataFrame, cols: list[str], y: str, max_p: float = 0.05) -> DataFrame:
    """Terms of a Gaussian GLM with their p-values, those at or below ``max_p`` only."""
    model = GeneralizedLinearRegression(family="gaussian", regParam=0.0).fit(assemble(df, cols, y))
    s = model.summary
    names = list(cols) + ["(intercept)"]
    coef = list(model.coefficients.toArray()) + [model.intercept]
    rows = [(n, float(b), float(e), float(p)) for n, b, e, p in
            zip(names, coef, s.coefficientStandardErrors, s.pValues)]
    out = df.sparkSession.createDataFrame(rows, "term string, coef double, std_error double, p_value double")
    return out.filter(F.col("p_value") <= max_p)


def _independent_rows(x: np.ndarray, need: int) -> list[int]:
    """The first rows, in order, each of which the ones before do not span; fewer than ``need`` if there are no more."""
    taken, axes = [], np.zeros((0, x.shape[1]))
    for i, row in enumerate(x):
        left = row - axes.T @ (axes @ row)
        left = left - axes.T @ (axes @ left)
        size = np.linalg.norm(left)
        if size > 1e-9 * max(np.linalg.norm(row), 1.0):
            taken.append(i)
            axes = np.vstack([axes, left / size])
            if len(taken) == need:
                break
    return taken


def ransac(df: DataFrame, cols: list[str], y: str, key: str, trials: int = 100, seed: int = 0, threshold: float | None = None,
           confidence: float = 0.99, at_once: int = 32) -> Linear:
    """Robust fit: candidates through minimal samples, inliers counted for all in one pass, refit on those of the best.

    Trial t draws from the t-th slice of the keys' hashes, about three times the rows it needs, and takes the first that
    determine a model; samples are fitted in the tasks that hold them, and only coefficients reach the driver. After
    ``at_once`` trials the share of inliers tells how many are enough to have met a sample without outliers at the
    ``confidence``; further ones are drawn only as far as that asks, ``trials`` at most. Ties go to the earlier trial. The
    threshold defaults to the median absolute deviation of the target. Rows with a NULL are left out.
    """
    need = len(cols) + 1
    data = durable(df.select(key, F.col(y).cast("double").alias("__y"), F.array(*[F.col(c).cast("double") for c in cols]).alias("__x")).filter(
        F.col("__y").isNotNull() & F.forall("__x", lambda v: v.isNotNull())))
    n = data.count()
    if threshold is None:
        med = exact_quantiles(data, {"__y": [0.5]})["__y"][0.5]
        dev = data.select(F.abs(F.col("__y") - F.lit(med)).alias("d"))
        threshold = exact_quantiles(dev, {"d": [0.5]})["d"][0.5]
    width = max(1, int(min(3 * need / max(n, 1), 1 / trials) * HASH_SPAN))
    best, done, wanted = (-1.0, None), 0, min(trials, at_once)
    while done < wanted:
        found = _candidates(data, key, seed, width, done, wanted, need)
        if found:
            slopes, bases = np.array([w[:-1] for w in found]).T, np.array([w[-1] for w in found])

            def hits(b, slopes=slopes, bases=bases):
                e = b.column("__y").to_numpy(zero_copy_only=False)[:, None] - batch_matrix(b.column("__x"), len(cols)) @ slopes - bases
                return (np.abs(e) <= threshold).sum(axis=0).astype(float)

            counts = sum_batches(data, hits, ["__x", "__y"])
            at = int(np.argmax(counts))
            if counts[at] > best[0]:
                best = (float(counts[at]), found[at])
        done = wanted
        clean = min(max(best[0], 0.0) / max(n, 1), 1.0) ** need
        enough = 1 if clean >= 1 else trials if clean <= 0 else math.ceil(math.log(1 - confidence) / math.log1p(-clean))
        wanted = min(trials, max(done, enough))
    if best[1] is None:
        raise ValueError("no sample of rows determines a model")
    w, b = best[1][:-1], float(best[1][-1])
    line = F.aggregate(F.zip_with("__x", F.array(*[F.lit(float(v)) for v in w]), lambda a, c: a * c), F.lit(b), lambda s, v: s + v)
    inliers = data.filter(F.abs(F.col("__y") - line) <= F.lit(float(threshold)))
    out = from_gram(gram_array(inliers.select(F.concat("__x", F.array("__y")).alias("x")), "x", need, names=[*cols, y]), ols_solve)
    out.info = {"threshold": float(threshold), "inliers": int(best[0]), "trials": done}
    return out


def _candidates(data: DataFrame, key: str, seed: int, width: int, first: int, last: int, need: int) -> list[np.ndarray]:
    """Coefficients and intercept of the trials from ``first`` to ``last`` whose sample determines a model, in order."""
    drawn = data.withColumn("__h", hash52(key, seed=seed)).filter(F.col("__h").between(first * width, last * width - 1))
    drawn = drawn.withColumn("__t", F.expr(f"cast(__h div {width} as int)"))
    rank = F.row_number().over(W.partitionBy("__t").orderBy("__h", "__y"))
    drawn = drawn.withColumn("__k", rank).filter(F.col("__k") <= 12 * need).select("__t", "__k", "__x", "__y")

    def fit(pdf):
        pdf = pdf.sort_values("__k")
        x = np.c_[np.stack(pdf["__x"].to_list()), np.ones(len(pdf))]
        rows = _independent_rows(x, need)
        w = np.linalg.solve(x[rows], pdf["__y"].to_numpy()[rows]).tolist() if len(rows) == need else []
        return pdf.__class__({"t": [int(pdf["__t"].iloc[0])], "w": [w]})

    got = drawn.groupBy("__t").applyInPandas(fit, "t int, w array<double>").filter(F.size("w") > 0).collect()
    return [np.array(r.w) for r in sorted(got, key=lambda r: r.t)]
