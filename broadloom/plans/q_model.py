"""Linear fits, decompositions, trees, stacking, search."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import RFormula
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from broadloom.operators import (
    decompose as D, encode as E, evaluate as V, gram as G, grower as Gr, linear as L, rangefinder as RF, sampling as S, search as H, sparse as Sp, stack as K, trees as T)
from broadloom.operators.ordering import contiguous_folds
from broadloom.plans.fixtures import table, wide, with_wide
from broadloom.plans.q_relational import MODELS, PREDS_WIDE_CTE, predictions_long
from broadloom.plans.q_split import POISSON_STEPS as POISSON_CDF
from broadloom.plans.registry import query
from broadloom.session import durable, new_path
from broadloom.sources import writers as Wr

X = ["X10", "X11", "X12", "X13", "X14", "X15", "X16", "X17", "X22"]


def planted(spark, sf, y: str = "y_lin") -> DataFrame:
    return wide(spark, sf, "ID", "tc", *X, y).withColumn("fold", (F.col("ID") % 5).cast("int"))


def rounded(df: DataFrame, *keep: str, digits: int = 6) -> DataFrame:
    return df.select(*keep, *[F.round(c, digits).alias(c) for c in df.columns if c not in keep])


# ---- closed forms with an SQL twin ------------------------------------------------------------------------

SUMS = """m AS (SELECT count(*)::DOUBLE AS n, avg(X22) AS mx, avg(y_lin) AS my, covar_pop(y_lin, X22) * count(*) AS sxy,
    var_pop(X22) * count(*) AS sxx, var_pop(y_lin) * count(*) AS syy, sum(X22 * X22)::DOUBLE AS rxx, sum(X22 * y_lin) AS rxy FROM wide)"""


def coef_sql(b: str, a: str = "my - b * mx") -> str:
    return with_wide(f"""SELECT '(intercept)' AS term, round({a}, 6) AS coef FROM (SELECT *, {b} AS b FROM m)
    UNION ALL SELECT 'X22', round(b, 6) FROM (SELECT *, {b} AS b FROM m)""", SUMS)


def one_feature(spark, sf):
    return G.gram(wide(spark, sf, "X22", "y_lin"), ["X22"], "y_lin")


@query("REG-1", coef_sql("sxy / sxx"))
def ols_simple(spark, sf):
    return rounded(L.ml_linear(wide(spark, sf, "X22", "y_lin"), ["X22"], "y_lin").table(spark), "term")


@query("REG-2", coef_sql("sxy / (sxx + 10)"))
def ridge_simple(spark, sf):
    return rounded(L.from_gram(one_feature(spark, sf), lambda m: L.ridge_solve(m, 10.0)).table(spark), "term")


@query("REG-3", coef_sql("sign(sxy) * greatest(abs(sxy / n) - 0.1::DOUBLE, 0) / (sxx / n)"))
def lasso_simple(spark, sf):
    return rounded(L.ml_linear(wide(spark, sf, "X22", "y_lin"), ["X22"], "y_lin", 0.1, 1.0).table(spark), "term")


@query("REG-4 REG-14", coef_sql("sign(sxy) * greatest(abs(sxy / n) - 0.5::DOUBLE, 0) / (sxx / n + 0.5::DOUBLE)"))
def enet_simple(spark, sf):
    return rounded(L.ml_linear(wide(spark, sf, "X22", "y_lin"), ["X22"], "y_lin", 1.0, 0.5).table(spark), "term")


@query("REG-6", coef_sql("sign(sxy) * greatest(abs(sxy / n) - 0.01::DOUBLE, 0) / (sxx / n)"))
def lars_simple(spark, sf):
    return rounded(L.lars(one_feature(spark, sf), 0.01).table(spark), "term")


@query("REG-10", coef_sql("rxy / (rxx + 0.6::DOUBLE)", "0::DOUBLE"))
def krr_simple(spark, sf):
    return rounded(L.kernel_ridge_linear(one_feature(spark, sf), 0.6).table(spark), "term")


@query("SMP-7", with_wide("""SELECT ID, round(y_lin - (y_lin - (my + sxy / sxx * (X22 - mx))) / (1 - (1 / n + (X22 - mx) * (X22 - mx) / sxx)), 6) AS loo_pred
    FROM wide, m""", SUMS))
def loo_press(spark, sf):
    df = wide(spark, sf, "ID", "X22", "y_lin")
    return rounded(L.press(df, G.gram(df, ["X22"], "y_lin"), "y_lin").select("ID", "loo_pred"), "ID")


FOLD_LINE = """f AS (SELECT k, regr_slope(y_lin, X22) AS b, regr_intercept(y_lin, X22) AS a
    FROM wide, (SELECT unnest([0, 1, 2, 3, 4]) AS k) WHERE tc = 1 AND ID // 2 % 5 <> k GROUP BY k)"""


@query("ENS-1 REG-1", with_wide("""SELECT ID, y_lin AS y, CAST(k AS INTEGER) AS fold, round(a + b * X22, 6) AS oof_pred
    FROM wide JOIN f ON ID // 2 % 5 = k WHERE tc = 1""", FOLD_LINE))
def oof_ols_simple(spark, sf):
    train = wide(spark, sf, "ID", "tc", "X22", "y_lin").filter("tc = 1") \
        .withColumn("fold", F.expr("cast(ID div 2 % 5 as int)"))
    scored = K.score_folds(train, K.fit_folds(train, ["X22"], "y_lin", "ID", 5, "ols"), "fold")
    return scored.select("ID", F.col("y_lin").alias("y"), "fold", F.round("oof_pred", 6).alias("oof_pred"))


@query("ENS-2 AGG-14", with_wide("""SELECT ID, round((SELECT avg(a) FROM f) + (SELECT avg(b) FROM f) * X22, 6) AS pred FROM wide WHERE tc = 0""", FOLD_LINE))
def fold_average(spark, sf):
    df = wide(spark, sf, "ID", "tc", "X22", "y_lin").withColumn("fold", F.expr("cast(ID div 2 % 5 as int)"))
    models = K.fit_folds(df.filter("tc = 1"), ["X22"], "y_lin", "ID", 5, "ols")
    return K.score_folds(df.filter("tc = 0"), models).select("ID", F.round("mean_pred", 6).alias("pred"))


TWO = ["X14", "X22"]
TWO_SUMS = """c AS (SELECT count(*)::DOUBLE AS n, avg(X14) AS ma, avg(X22) AS mb, avg(y_lin) AS my, var_pop(X14) AS a, var_pop(X22) AS d,
    covar_pop(X14, X22) AS b, covar_pop(X14, y_lin) AS u, covar_pop(X22, y_lin) AS v FROM wide)"""


def two_sql(a: str, b: str, cte: str = "SELECT * FROM c") -> str:
    return with_wide(f"""SELECT '(intercept)' AS term, round(my - ({a}) * ma - ({b}) * mb, 6) AS coef FROM q
    UNION ALL SELECT 'X14', round({a}, 6) FROM q UNION ALL SELECT 'X22', round({b}, 6) FROM q""", TWO_SUMS, f"q AS ({cte})")


def two_gram(spark, sf):
    return G.gram(wide(spark, sf, *TWO, "y_lin"), TWO, "y_lin")


@query("REG-1 LA-1", two_sql("(d * u - b * v) / (a * d - b * b)", "(a * v - b * u) / (a * d - b * b)"))
def ols_two(spark, sf):
    return rounded(L.ml_linear(wide(spark, sf, *TWO, "y_lin"), TWO, "y_lin").table(spark), "term")


@query("REG-2 LA-1", two_sql("((d + r) * u - b * v) / ((a + r) * (d + r) - b * b)", "((a + r) * v - b * u) / ((a + r) * (d + r) - b * b)",
                             "SELECT *, 1 / n AS r FROM c"))
def ridge_two(spark, sf):
    return rounded(L.from_gram(two_gram(spark, sf), lambda m: L.ridge_solve(m, 1.0)).table(spark), "term")


@query("REG-11", two_sql("u * t", "v * t", "SELECT *, (u * u + v * v) / (a * u * u + 2 * b * u * v + d * v * v) AS t FROM c"))
def pls_two(spark, sf):
    return rounded(L.pls(two_gram(spark, sf), 1).table(spark), "term")


@query("REG-12", two_sql("p * (p * u + w * v) / e", "w * (p * u + w * v) / e", """SELECT *, b / l AS p, (e - a) / l AS w FROM (
    SELECT *, sqrt(b * b + (e - a) * (e - a)) AS l FROM (SELECT *, (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) AS e FROM c))"""))
def pcr_two(spark, sf):
    return rounded(L.pcr(two_gram(spark, sf), 1).table(spark), "term")


@query("REG-7", two_sql("CASE WHEN abs(u) / sqrt(a) > abs(v) / sqrt(d) THEN u / a ELSE 0 END",
                        "CASE WHEN abs(u) / sqrt(a) > abs(v) / sqrt(d) THEN 0 ELSE v / d END"))
def omp_two(spark, sf):
    return rounded(L.omp(two_gram(spark, sf), 1).table(spark), "term")


GRAM_COLS = ["X14", "X15", "X22", "y_lin"]


@query("LA-1", with_wide("SELECT fold, i, j, round(value, 4) AS value FROM (" + " UNION ALL ".join(
    ["SELECT CAST(ID % 5 AS INTEGER) AS fold, -1 AS i, -1 AS j, count(*)::DOUBLE AS value FROM wide GROUP BY 1"]
    + [f"SELECT CAST(ID % 5 AS INTEGER), -1, {j}, sum({c})::DOUBLE FROM wide GROUP BY 1" for j, c in enumerate(GRAM_COLS)]
    + [f"SELECT CAST(ID % 5 AS INTEGER), {i}, {j}, sum({a} * {GRAM_COLS[j]})::DOUBLE FROM wide GROUP BY 1"
       for i, a in enumerate(GRAM_COLS) for j in range(i, len(GRAM_COLS))]) + ")"))
def gram(spark, sf):
    df = wide(spark, sf, "ID", *GRAM_COLS).withColumn("fold", (F.col("ID") % 5).cast("int"))
    return G.gram_frame(df, GRAM_COLS, "fold").withColumn("value", F.round("value", 4))


@query("LA-1 AGG-7", """SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sum(e[i + 1] * e[j + 1]), 4) AS value
    FROM (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings), (SELECT unnest(range(64)) AS i), (SELECT unnest(range(64)) AS j)
    WHERE i <= j GROUP BY i, j""")
def gram_vectors(spark, sf):
    _, _, g = G.gram_array(table(spark, sf, "embeddings"), "embedding", 64).sums()
    rows = [(i, j, float(g[i, j])) for i in range(64) for j in range(i, 64)]
    return spark.createDataFrame(rows, "i int, j int, value double").withColumn("value", F.round("value", 4))


FOLD_RIDGE = """r AS (SELECT al AS alpha FROM (SELECT unnest([0.1::DOUBLE, 1, 10]) AS al)),
tr AS (SELECT k, count(*)::DOUBLE AS n, avg(X22) AS mx, avg(y_lin) AS my, covar_pop(y_lin, X22) * count(*) AS sxy, var_pop(X22) * count(*) AS sxx
    FROM wide, (SELECT unnest([0, 1, 2, 3, 4]) AS k) WHERE ID % 5 <> k GROUP BY k),
mse AS (SELECT alpha, avg(e) AS e FROM (SELECT alpha, k, avg(pow(y_lin - my - sxy / (sxx + alpha) * (X22 - mx), 2)) AS e
    FROM wide JOIN tr ON ID % 5 = k, r GROUP BY alpha, k) GROUP BY alpha)"""


@query("REG-2", with_wide("""SELECT arg_min(alpha, e) AS alpha, round(min(e), 6) AS mse,
    round((SELECT sxy / (sxx + (SELECT arg_min(alpha, e) FROM mse)) FROM m), 6) AS coef FROM mse""", SUMS, FOLD_RIDGE))
def ridge_cv_simple(spark, sf):
    df = wide(spark, sf, "ID", "X22", "y_lin").withColumn("fold", (F.col("ID") % 5).cast("int"))
    m = L.ridge_cv(G.gram(df, ["X22"], "y_lin", "fold"))
    return rounded(spark.createDataFrame([(m.info["alpha"], m.info["mse"], float(m.coef[0]))], "alpha double, mse double, coef double"))


@query("REG-13", with_wide("""SELECT term, round(coef, 6) AS coef, round(se, 6) AS std_error FROM (
    SELECT 'X22' AS term, sxy / sxx AS coef, sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) AS se FROM m
    UNION ALL SELECT '(intercept)', my - sxy / sxx * mx, sqrt((syy - sxy * sxy / sxx) / (n - 2) * (1 / n + mx * mx / sxx)) FROM m)""", SUMS))
def glm_simple(spark, sf):
    return rounded(L.glm_terms(wide(spark, sf, "X22", "y_lin"), ["X22"], "y_lin", 0.05).drop("p_value"), "term")


def elimination_sql(cell: str, diagonal: str = "0", intercept: bool = True) -> str:
    """Normal equations of all of X solved by Gauss-Jordan steps, one materialised table per pivot."""
    p = len(X)
    cols = [*X, "y_lin"]
    pick = lambda i, j: cell.format(a=cols[i], b=cols[j])
    ctes = ["s0 AS MATERIALIZED (" + " UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, {pick(i, j)}{f' + {diagonal}' if i == j else ''} AS v FROM wide"
        for i in range(p) for j in range(p + 1)) + ")"]
    for k in range(p):
        ctes.append(f"""s{k + 1} AS MATERIALIZED (SELECT t.i, t.j, CASE WHEN t.i = {k} THEN t.v / p.v ELSE t.v - c.v * r.v / p.v END AS v
            FROM s{k} t JOIN s{k} c ON c.i = t.i AND c.j = {k} JOIN s{k} r ON r.i = {k} AND r.j = t.j JOIN s{k} p ON p.i = {k} AND p.j = {k})""")
    coef = " UNION ALL ".join(
        f"SELECT '{c}' AS term, v AS coef FROM s{p} WHERE i = {i} AND j = {p}" for i, c in enumerate(X))
    ctes.append(f"coef AS MATERIALIZED ({coef})")
    base = "(SELECT avg(y_lin) FROM wide) - (" + " + ".join(
        f"(SELECT coef FROM coef WHERE term = '{c}') * (SELECT avg({c}) FROM wide)" for c in X) + ")" if intercept else "0::DOUBLE"
    return with_wide(f"SELECT term, round(coef, 6) AS coef FROM coef UNION ALL SELECT '(intercept)', round({base}, 6)", *ctes)


CENTRED = "covar_pop({a}, {b}) * count(*)"
RAW = "sum({a} * {b})::DOUBLE"


# ---- linear fits on the planted target ----------------------------------------------------------------------

def _fit(name):
    def run(spark, sf):
        df = planted(spark, sf)
        return rounded(K.GRAM_LEARNERS[name](G.gram(df, X, "y_lin", "fold")).table(spark), "term")
    run.__name__ = name
    return run


def descent_sql(l1: float, l2: float, sweeps: int = 600) -> str:
    """Cyclic coordinate descent on the covariances, one coordinate per step of a recursive query."""
    p = len(X)
    q = ", ".join("[" + ", ".join(f"covar_pop({a}, {b})" for b in X) + "]" for a in X)
    c = ", ".join(f"covar_pop({a}, y_lin)" for a in X)
    rho = "(c[j] - list_dot_product(q[j], w) + q[j][j] * w[j])"
    walk = f"""walk AS (SELECT 0 AS t, 1 AS j, [{", ".join(["0::DOUBLE"] * p)}] AS w
        UNION ALL SELECT t + 1, j % {p} + 1, w[1:j - 1] || [sign({rho}) * greatest(abs({rho}) - {l1}::DOUBLE, 0) / (q[j][j] + {l2}::DOUBLE)] || w[j + 1:]
        FROM walk, cov WHERE t < {p * sweeps})"""
    names = "[" + ", ".join(f"'{x}'" for x in X) + "]"
    means = ", ".join(f"avg({x})" for x in X)
    return with_wide(f"""SELECT term, round(coef, 6) AS coef FROM (SELECT unnest({names}) AS term, unnest(w) AS coef FROM last
        UNION ALL SELECT '(intercept)', my - list_dot_product(w, mx) FROM last, cov)""",
        f"cov AS MATERIALIZED (SELECT [{q}] AS q, [{c}] AS c, [{means}] AS mx, avg(y_lin) AS my FROM wide)", walk,
        f"last AS (SELECT w FROM walk WHERE t = {p * sweeps})").replace("WITH ", "WITH RECURSIVE ", 1)


#: One atom of the pursuit: the column most correlated with the target, fitted alone.
ONE_ATOM = with_wide("""SELECT term, round(coef, 6) AS coef FROM (SELECT c AS term, CASE WHEN c = (SELECT arg_max(c, abs(sxy) / sqrt(sxx)) FROM one)
    THEN sxy / sxx ELSE 0 END AS coef FROM one UNION ALL SELECT '(intercept)', my - sxy / sxx * mx FROM one
    WHERE c = (SELECT arg_max(c, abs(sxy) / sqrt(sxx)) FROM one))""",
    "one AS MATERIALIZED (" + " UNION ALL ".join(
        f"SELECT '{c}' AS c, covar_pop({c}, y_lin) AS sxy, var_pop({c}) AS sxx, avg({c}) AS mx, avg(y_lin) AS my FROM wide" for c in X) + ")")

for _name, _ids, _sql in [("bayes_ridge", "REG-8", None), ("enet", "REG-4", descent_sql(0.5, 0.5)), ("enet_cv", "REG-4", None),
                          ("lasso", "REG-3", descent_sql(0.1, 0.0)), ("lasso_cv", "REG-3", None), ("lasso_lars", "REG-6", descent_sql(0.01, 0.0)),
                          ("lasso_lars_cv", "REG-6", None), ("lasso_lars_ic", "REG-6", None), ("omp", "REG-7", ONE_ATOM),
                          ("omp_cv", "REG-7", None), ("ridge_cv", "REG-2", None)]:
    query(_ids, _sql)(_fit(_name))
query("REG-10", elimination_sql(RAW, "0.6::DOUBLE", intercept=False))(_fit("kernel_ridge"))
query("REG-2", elimination_sql(CENTRED, "1"))(_fit("ridge"))


@query("REG-1 PRJ-2", elimination_sql(CENTRED))
def ols_multi(spark, sf):
    return rounded(L.ml_linear(planted(spark, sf), X, "y_lin").table(spark), "term")


@query("REG-5")
def huber(spark, sf):
    df = planted(spark, sf, "y_out")
    return rounded(L.ml_linear(df, X, "y_out", loss="huber", max_iter=100, tol=1e-6).table(spark), "term", digits=3)


@query("REG-9")
def ransac(spark, sf):
    return rounded(L.ransac(planted(spark, sf, "y_out"), X, "y_out", "ID").table(spark), "term", digits=3)


RANSAC_TRIALS, RANSAC_WITHIN = 8, 12.3456


@query("REG-9", with_wide(f"""SELECT unnest(['(intercept)', 'X22']) AS term, round(unnest([regr_intercept(y, x), regr_slope(y, x)]), 6) AS coef
    FROM h, best WHERE abs(y - sl * x - ic) <= {RANSAC_WITHIN}""",
    "h AS (SELECT X22::DOUBLE AS x, y_out AS y, ('0x' || substr(md5(ID || '|0'), 1, 13))::BIGINT AS h FROM wide)",
    f"""s AS (SELECT h // w AS t, x, y, row_number() OVER (PARTITION BY h // w ORDER BY h, y) AS k
      FROM h, (SELECT floor(least(6::DOUBLE / count(*), 1::DOUBLE / {RANSAC_TRIALS}) * 4503599627370496)::BIGINT AS w FROM h) WHERE h // w < {RANSAC_TRIALS})""",
    """m AS (SELECT t, (y2 - y1) / (x2 - x1) AS sl, y1 - x1 * (y2 - y1) / (x2 - x1) AS ic FROM (
      SELECT t, x1, y1, arg_min(x, k) AS x2, arg_min(y, k) AS y2 FROM s JOIN (SELECT t, x AS x1, y AS y1 FROM s WHERE k = 1) USING (t) WHERE x <> x1 GROUP BY ALL))""",
    f"best AS (SELECT sl, ic FROM m, h GROUP BY t, sl, ic ORDER BY count(*) FILTER (abs(y - sl * x - ic) <= {RANSAC_WITHIN}) DESC, t LIMIT 1)"))
def ransac_line(spark, sf):
    df = wide(spark, sf, "ID", "X22", "y_out")
    return rounded(L.ransac(df, ["X22"], "y_out", "ID", trials=RANSAC_TRIALS, threshold=RANSAC_WITHIN).table(spark), "term")


@query("REG-11")
def pls_choice(spark, sf):
    return rounded(L.pls_cv(G.gram(planted(spark, sf), X, "y_lin", "fold")).table(spark), "term")


@query("REG-12")
def pcr_choice(spark, sf):
    return rounded(L.pcr_cv(G.gram(planted(spark, sf), X, "y_lin", "fold")).table(spark), "term")


@query("REG-13")
def glm_pvalues(spark, sf):
    return rounded(L.glm_terms(planted(spark, sf), X, "y_lin", 0.05), "term", digits=4)


def formula_sql() -> str:
    """Dummies of all levels but one, eliminated like any columns; which level is left out does not matter to the fit."""
    cols = [f"(X0 = '{v}')::INTEGER" for v in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")] + [
        f"(X2 = '{v}')::INTEGER" for v in ("F", "O")] + ["X14", "X22", "y_lin"]
    p = len(cols) - 1
    ctes = ["s0 AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, covar_pop({cols[i]}, {cols[j]}) AS v FROM wide"
                                                       for i in range(p) for j in range(p + 1)) + ")"]
    for k in range(p):
        ctes.append(f"""s{k + 1} AS MATERIALIZED (SELECT t.i, t.j, CASE WHEN t.i = {k} THEN t.v / p.v ELSE t.v - c.v * r.v / p.v END AS v
            FROM s{k} t JOIN s{k} c ON c.i = t.i AND c.j = {k} JOIN s{k} r ON r.i = {k} AND r.j = t.j JOIN s{k} p ON p.i = {k} AND p.j = {k})""")
    explained = f"(SELECT sum(a.v * b.v) FROM s{p} a JOIN s0 b ON a.i = b.i AND a.j = {p} AND b.j = {p})"
    return with_wide(f"SELECT n, round(e / s, 6) AS r2, round(sqrt(s - e), 6) AS rmse FROM (SELECT count(*) AS n, var_pop(y_lin) AS s, {explained} AS e FROM wide)", *ctes)


@query("ENC-6 REG-1", formula_sql())
def formula_fit(spark, sf):
    """Formula with factors: levels expand to dummies, then one linear fit."""
    df = wide(spark, sf, "ID", "X0", "X2", "X14", "X22", "y_lin")
    data = RFormula(formula="y_lin ~ X0 + X2 + X14 + X22").fit(df).transform(df)
    model = LinearRegression(solver="normal").fit(data)
    scored = model.transform(data)
    return rounded(V.regression_metrics(scored, "label", "prediction").select("n", "r2", "rmse"), "n")


# ---- components of the vectors ---------------------------------------------------------------------------------

WIDTH = 64


def vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"),
                                                 (F.col("vec_id") % 2 == 0).alias("train"))


def _components(fitted, df, k: int, keep=("vec_id",)) -> DataFrame:
    return D.append_components(fitted.transform(df, "x", "c").select(*keep, "c"), "c", k)


@query("LA-2 LA-9")
def pca_append(spark, sf):
    df = vectors(spark, sf)
    return _components(D.pca(df.filter("train"), "x", 12), df, 12)


@query("LA-3")
def prcomp_cut(spark, sf):
    df = vectors(spark, sf)
    fitted, k = D.pca_cut(df.filter("train"), "x", WIDTH)
    return _components(fitted, df, k)


@query("LA-4 LA-9")
def svd_append(spark, sf):
    df = vectors(spark, sf)
    return _components(D.truncated_svd(df.filter("train"), "x", 12), df, 12)


@query("LA-5")
def ica(spark, sf):
    df = vectors(spark, sf)
    return _components(D.fast_ica(df.filter("train"), "x", WIDTH, 12, max_iter=100), df, 12)


def _dots(make, prefix: str) -> str:
    m = make(WIDTH, 12).matrix
    cols = ", ".join(f"round(list_dot_product(e, [{', '.join(f'{v!r}::DOUBLE' for v in map(float, m[:, j]))}]), 6) AS {prefix}_{j + 1}"
                     for j in range(12))
    return f"SELECT vec_id, {cols} FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


@query("LA-6 LA-9", _dots(D.gaussian_projection, "c"))
def grp(spark, sf):
    return rounded(_components(D.gaussian_projection(WIDTH, 12), vectors(spark, sf), 12), "vec_id")


@query("LA-7 LA-9", _dots(D.sparse_projection, "c"))
def srp(spark, sf):
    return rounded(_components(D.sparse_projection(WIDTH, 12), vectors(spark, sf), 12), "vec_id")


# Components of two columns have a closed form: the eigenvectors of a symmetric 2 x 2 matrix (a, b; b, d).
EIGEN_2 = """(SELECT *, b / l1 AS u1, (e1 - a) / l1 AS w1, -((e1 - a) / l1) AS u2, b / l1 AS w2 FROM (
    SELECT *, sqrt(b * b + (e1 - a) * (e1 - a)) AS l1 FROM (
      SELECT *, (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) AS e1 FROM {src})))"""


def two_components_sql(src: str, x: str, w: str) -> str:
    sign = "CASE WHEN abs({u}) >= abs({w}) THEN sign({u}) ELSE sign({w}) END"
    score = lambda u, v: f"round(({u} * {x} + {v} * {w}) * {sign.format(u=u, w=v)}, 6)"
    return with_wide(f"SELECT ID, {score('u1', 'w1')} AS c_1, {score('u2', 'w2')} AS c_2 FROM wide, {EIGEN_2.format(src=src)}")


def two_columns(spark, sf):
    return wide(spark, sf, "ID", "tc", *TWO).withColumn("x", D.feature_array(TWO))


@query("LA-2", two_components_sql("(SELECT avg(X14) AS ma, avg(X22) AS mb, var_pop(X14) AS a, var_pop(X22) AS d, covar_pop(X14, X22) AS b FROM wide WHERE tc = 1)",
                                  "(X14 - ma)", "(X22 - mb)"))
def pca_two(spark, sf):
    df = two_columns(spark, sf)
    return rounded(_components(D.pca(df.filter("tc = 1"), "x", 2), df, 2, ("ID",)), "ID")


@query("LA-4", two_components_sql("(SELECT sum(X14 * X14)::DOUBLE AS a, sum(X22 * X22)::DOUBLE AS d, sum(X14 * X22)::DOUBLE AS b FROM wide WHERE tc = 1)",
                                  "X14", "X22"))
def svd_two(spark, sf):
    df = two_columns(spark, sf)
    return rounded(_components(D.truncated_svd(df.filter("tc = 1"), "x", 2), df, 2, ("ID",)), "ID")


@query("LA-2", two_components_sql("(SELECT avg(X14) AS ma, avg(X22) AS mb, var_pop(X14) AS a, var_pop(X22) AS d, covar_pop(X14, X22) AS b FROM wide WHERE tc = 1)",
                                  "(X14 - ma)", "(X22 - mb)"))
def pca_wide_two(spark, sf):
    df = two_columns(spark, sf)
    return rounded(_components(RF.leading(df.filter("tc = 1"), "x", 2, 2), df, 2, ("ID",)), "ID")


@query("LA-4", two_components_sql("(SELECT sum(X14 * X14)::DOUBLE AS a, sum(X22 * X22)::DOUBLE AS d, sum(X14 * X22)::DOUBLE AS b FROM wide WHERE tc = 1)",
                                  "X14", "X22"))
def svd_wide_two(spark, sf):
    df = two_columns(spark, sf)
    return rounded(_components(RF.leading(df.filter("tc = 1"), "x", 2, 2, centre=False), df, 2, ("ID",)), "ID")


@query("LA-3", with_wide("""SELECT ID, round(abs((X14 - ma) / sa + (X22 - mb) / sb) / sqrt(2), 6) AS size_1, keep FROM wide,
    (SELECT avg(X14) AS ma, avg(X22) AS mb, stddev_samp(X14) AS sa, stddev_samp(X22) AS sb,
     CASE WHEN sqrt((1 - corr(X14, X22)) / (1 + corr(X14, X22))) > 0.25 THEN 2 ELSE 1 END AS keep FROM wide WHERE tc = 1)"""))
def prcomp_two(spark, sf):
    df = two_columns(spark, sf)
    fitted, keep = D.pca_cut(df.filter("tc = 1"), "x", 2)
    out = _components(fitted, df, 2, ("ID",))
    return out.select("ID", F.round(F.abs("c_1"), 6).alias("size_1"), F.lit(keep).alias("keep"))


@query("LA-8 PRJ-14")
def nmf(spark, sf):
    df = vectors(spark, sf)
    return _components(D.nmf(df.filter("train"), "x", WIDTH, 9, max_iter=20), df, 9)


@query("LA-10 PRJ-5")
def comps_only(spark, sf):
    df = vectors(spark, sf).select("vec_id", "label", "x", "train")
    return _components(D.pca(df.filter("train"), "x", 8), df, 8, keep=df.columns[0:2])


@query("LA-2 LA-6 LA-7")
def wide_components(spark, sf):
    """Encoded wide table with principal and random components beside the raw columns."""
    df = wide(spark, sf, "ID", "tc", *X).withColumn("x", D.feature_array(X))
    df = D.append_components(D.pca(df.filter("tc = 1"), "x", 4).transform(df, "x"), "pca", 4)
    df = D.append_components(D.gaussian_projection(len(X), 3).transform(df, "x"), "grp", 3)
    return D.append_components(D.sparse_projection(len(X), 3).transform(df, "x"), "srp", 3).drop("x")


# ---- trees -----------------------------------------------------------------------------------------------------

def _scored(model, df, y="y_lin") -> DataFrame:
    m = V.regression_metrics(model.transform(df), y, "pred")
    return rounded(m.select("n", "r2", "rmse", "mae"), "n", digits=4)


def halves(spark, sf, y: str = "y_lin"):
    df = durable(planted(spark, sf, y))
    return df.filter("tc = 1"), df.filter("tc = 0")


@query("REG-15")
def tree(spark, sf):
    a, b = halves(spark, sf)
    return _scored(T.tree(a, X, "y_lin"), b)


STUMP = with_wide("SELECT ID, round(m, 6) AS pred FROM wide JOIN (SELECT X14 AS g, avg(y_lin) AS m FROM wide WHERE tc = 1 GROUP BY X14) ON X14 = g WHERE tc = 0")


def _stump(fit):
    """One 0/1 column: every sound tree method predicts the training mean of its value."""
    def run(spark, sf):
        df = wide(spark, sf, "ID", "tc", "X14", "y_lin")
        return fit(df.filter("tc = 1")).transform(df.filter("tc = 0")).select("ID", F.round("pred", 6).alias("pred"))
    return run


for _name, _ids, _one in [
        ("tree_stump", "REG-15", lambda d: T.tree(d, ["X14"], "y_lin", 1)),
        ("forest_stump", "REG-16", lambda d: T.forest(d, ["X14"], "y_lin", trees=3, max_depth=1, mtry="all", bootstrap=False)),
        ("gbt_stump", "REG-18", lambda d: T.boosted(d, ["X14"], "y_lin", rounds=2, max_depth=1)),
        ("adaboost_stump", "REG-21", lambda d: T.adaboost_r2(d, ["X14"], "y_lin", "ID", rounds=1, max_depth=1))]:
    _run = _stump(_one)
    _run.__name__ = _name
    query(_ids, STUMP)(_run)


@query("REG-16")
def forest(spark, sf):
    a, b = halves(spark, sf)
    return _scored(T.forest(a, X, "y_lin", trees=20), b)


@query("REG-16")
def forest_nobootstrap(spark, sf):
    a, b = halves(spark, sf)
    return _scored(T.forest(a, X, "y_lin", trees=20, bootstrap=False), b)


@query("REG-18")
def gbt(spark, sf):
    a, b = halves(spark, sf)
    return _scored(T.boosted(a, X, "y_lin", rounds=20, subsample=0.921), b)


@query("REG-19 WIN-7")
def gbt_early(spark, sf):
    """Stops after five rounds without a better R2 on the held-out rows and goes back to the best round."""
    df = durable(planted(spark, sf))
    a = S.holdout(df.filter("tc = 1"), "ID", 0.2, 0)
    model = Gr.boost(a, X, "y_lin", "ID", rounds=100, step=0.3, max_depth=4, validation="holdout", patience=5)
    return model.transform(df.filter("tc = 0")).select("ID", F.round("pred", 4).alias("pred"))


FLAG_PAIR = ["X14", "X15"]


def flag_pair(spark, sf):
    return durable(wide(spark, sf, "ID", "tc", "X22", *FLAG_PAIR, "y_lin"))


EARLY = {"rounds": 60, "step": 0.1, "patience": 5}


@query("REG-19 WIN-7", with_wide("""SELECT ID, stop::INTEGER AS stop_round, b::INTEGER AS best_round, round(base + f[1 + X14 * 2 + X15], 6) AS pred
    FROM wide, c, (SELECT it.f, b, stop FROM chosen JOIN it ON it.r = b + 1) WHERE tc = 0""",
    "c AS (SELECT avg(y_lin) AS base FROM wide WHERE tc = 1 AND X22 <> 4)",
    """p AS (SELECT list(coalesce(n, 0) ORDER BY i) AS n, list(coalesce(s, 0) ORDER BY i) AS s, list(coalesce(vn, 0) ORDER BY i) AS vn,
           list(coalesce(vs, 0) ORDER BY i) AS vs, list(coalesce(vq, 0) ORDER BY i) AS vq
      FROM (SELECT unnest([0, 1, 2, 3]) AS i) LEFT JOIN (
        SELECT X14 * 2 + X15 AS i, count(*) FILTER (X22 <> 4) AS n, sum(y_lin - base) FILTER (X22 <> 4) AS s, count(*) FILTER (X22 = 4) AS vn,
               sum(y_lin - base) FILTER (X22 = 4) AS vs, sum(pow(y_lin - base, 2)) FILTER (X22 = 4) AS vq FROM wide, c WHERE tc = 1 GROUP BY 1) USING (i))""",
    f"""it AS (SELECT 0 AS r, [0.0::DOUBLE, 0, 0, 0] AS f UNION ALL
      SELECT r + 1, CASE WHEN pow(a1, 2) / (n[3] + n[4]) + pow(a0, 2) / (n[1] + n[2]) >= pow(b1, 2) / (n[2] + n[4]) + pow(b0, 2) / (n[1] + n[3])
        THEN [f[1] + {EARLY["step"]} * a0 / (n[1] + n[2]), f[2] + {EARLY["step"]} * a0 / (n[1] + n[2]), f[3] + {EARLY["step"]} * a1 / (n[3] + n[4]), f[4] + {EARLY["step"]} * a1 / (n[3] + n[4])]
        ELSE [f[1] + {EARLY["step"]} * b0 / (n[1] + n[3]), f[2] + {EARLY["step"]} * b1 / (n[2] + n[4]), f[3] + {EARLY["step"]} * b0 / (n[1] + n[3]), f[4] + {EARLY["step"]} * b1 / (n[2] + n[4])] END
      FROM (SELECT r, f, n, s[3] - n[3] * f[3] + s[4] - n[4] * f[4] AS a1, s[1] - n[1] * f[1] + s[2] - n[2] * f[2] AS a0,
                   s[2] - n[2] * f[2] + s[4] - n[4] * f[4] AS b1, s[1] - n[1] * f[1] + s[3] - n[3] * f[3] AS b0 FROM it, p WHERE r < {EARLY["rounds"]}))""",
    """curve AS (SELECT r - 1 AS r, 1 - list_sum(list_transform([1, 2, 3, 4], lambda i: vq[i] - 2 * f[i] * vs[i] + f[i] * f[i] * vn[i]))
        / (list_sum(vq) - pow(list_sum(vs), 2) / list_sum(vn)) AS r2 FROM it, p WHERE r > 0)""",
    "walk AS (SELECT r, arg_max(r, r2) OVER (ORDER BY r) AS b FROM curve)",
    f"""chosen AS (SELECT b, r AS stop FROM walk WHERE r - b >= {EARLY["patience"]} OR r = {EARLY["rounds"] - 1} ORDER BY r LIMIT 1)""").replace("WITH wide", "WITH RECURSIVE wide", 1))
def gbt_early_flags(spark, sf):
    """Stumps on two flags; the rows of orders with four lines judge, where the first flag tells less than elsewhere."""
    df = flag_pair(spark, sf)
    model = Gr.boost(df.filter("tc = 1").withColumn("judge", F.col("X22") == 4), FLAG_PAIR, "y_lin", "ID", max_depth=1, validation="judge", **EARLY)
    return model.transform(df.filter("tc = 0")).select("ID", F.lit(model.info["stop_round"]).alias("stop_round"),
                                                       F.lit(model.info["best_round"]).alias("best_round"), F.round("pred", 6).alias("pred"))


@query("REG-17")
def extra_trees(spark, sf):
    a, b = halves(spark, sf)
    return Gr.extra_trees(a, X, "y_lin", "ID", trees=10).transform(b).select("ID", F.round("pred", 4).alias("pred"))


@query("REG-17", with_wide("""SELECT ID, round(avg(CASE WHEN X22 <= t THEN l ELSE r END), 6) AS pred FROM wide, (
      SELECT k, t, avg(y_lin) FILTER (X22 <= t) AS l, avg(y_lin) FILTER (X22 > t) AS r FROM wide, (
        SELECT k, least(lo + ('0x' || substr(md5('1|' || k || '|1|0'), 1, 13))::BIGINT / pow(2, 52) * (hi - lo), hi - 0.5) AS t
        FROM (SELECT unnest([0, 1, 2]) AS k), (SELECT min(X22) AS lo, max(X22) AS hi FROM wide WHERE tc = 1)) WHERE tc = 1 GROUP BY k, t) WHERE tc = 0 GROUP BY ID"""))
def extra_trees_cut(spark, sf):
    """Three trees of one split each, at thresholds drawn between the least and the greatest count."""
    df = flag_pair(spark, sf)
    model = Gr.extra_trees(df.filter("tc = 1"), ["X22"], "y_lin", "ID", trees=3, max_depth=1, seed=1)
    return model.transform(df.filter("tc = 0")).select("ID", F.round("pred", 6).alias("pred"))


@query("REG-20")
def gbt_huber(spark, sf):
    df = durable(planted(spark, sf, "y_out"))
    model = Gr.boost(df.filter("tc = 1"), X, "y_out", "ID", rounds=10, step=0.3, max_depth=3, loss="huber", share=0.55, subsample=0.7, min_leaf=18,
                     min_split=14)
    return model.transform(df.filter("tc = 0")).select("ID", F.round("pred", 4).alias("pred"))


def _huber_sql(rounds=3, step=0.3, alpha=0.9):
    """Rounds of stumps on two flags, one after the other."""
    ctes = ["r0 AS (SELECT ID, tc, X14, X15, y_out AS y, b AS f FROM wide, (SELECT quantile_disc(y_out, 0.5) AS b FROM wide WHERE tc = 1))"]
    for i in range(rounds):
        ctes += [f"d{i} AS (SELECT quantile_disc(abs(y - f), {alpha}) AS d FROM r{i} WHERE tc = 1)",
                 f"g{i} AS (SELECT X14, X15, greatest(-d, least(d, y - f)) AS g, y - f AS e FROM r{i}, d{i} WHERE tc = 1)",
                 f"""s{i} AS (SELECT (SELECT sum(s * s / n) FROM (SELECT sum(g) AS s, count(*) AS n FROM g{i} GROUP BY X14))
                     >= (SELECT sum(s * s / n) FROM (SELECT sum(g) AS s, count(*) AS n FROM g{i} GROUP BY X15)) AS one)""",
                 f"m{i} AS (SELECT CASE WHEN one THEN X14 ELSE X15 END AS k, quantile_disc(e, 0.5) AS m FROM g{i}, s{i} GROUP BY 1)",
                 f"v{i} AS (SELECT k, any_value(m) + avg(greatest(-d, least(d, e - m))) AS v FROM g{i}, s{i}, d{i}, m{i} WHERE k = CASE WHEN one THEN X14 ELSE X15 END GROUP BY k)",
                 f"r{i + 1} AS (SELECT ID, tc, X14, X15, y, f + {step} * v AS f FROM r{i}, s{i} JOIN v{i} ON k = CASE WHEN one THEN X14 ELSE X15 END)"]
    return with_wide(f"SELECT ID, round(f, 6) AS pred FROM r{rounds} WHERE tc = 0", *ctes)


@query("REG-20", _huber_sql())
def gbt_huber_stumps(spark, sf):
    df = durable(wide(spark, sf, "ID", "tc", *FLAG_PAIR, "y_out"))
    model = Gr.boost(df.filter("tc = 1"), FLAG_PAIR, "y_out", "ID", rounds=3, step=0.3, max_depth=1, loss="huber")
    return model.transform(df.filter("tc = 0")).select("ID", F.round("pred", 6).alias("pred"))


@query("REG-18")
def gbt_abs(spark, sf):
    a, b = halves(spark, sf)
    return _scored(T.boosted(a, X, "y_lin", rounds=10, step=0.3, loss="absolute"), b)


@query("REG-21")
def adaboost_r2(spark, sf):
    a, b = halves(spark, sf)
    return _scored(T.adaboost_r2(a, X, "y_lin", "ID", rounds=300, learning_rate=0.01), b)


@query("REG-22 SMP-8")
def bagging(spark, sf):
    a, b = halves(spark, sf)
    return _scored(T.bagged_trees(a, X, "y_lin", "ID", bags=6), b)


@query("REG-23")
def iforest_flag(spark, sf):
    df = durable(planted(spark, sf, "y_out").drop("fold"))
    model = T.isolation_forest(df, ["y_out", "X22", "X14"], "ID")
    return T.outlier_flags(model, df).select("ID", F.round("score", 6).alias("score"), "flag")


@query("REG-24")
def importances(spark, sf):
    a, _ = halves(spark, sf)
    return rounded(T.forest(a, X, "y_lin", trees=20).importances(spark), "feature").orderBy(F.desc("importance"), "feature")


@query("ENC-6 LA-1 REG-2", """WITH g AS (SELECT o_custkey::VARCHAR AS level, count(*)::DOUBLE AS n, sum(o_totalprice / 1000) AS s FROM orders GROUP BY 1),
b AS (SELECT sum(s / (n + 1)) / sum(n / (n + 1)) AS b0 FROM g)
SELECT level, round((s - n * b0) / (n + 1), 4) AS coef FROM g, b""")
def sparse_ridge(spark, sf):
    """A dummy per customer, a penalty on each and none on the intercept."""
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.col("o_totalprice") / 1000).alias("y"))
    model = Sp.sparse_ridge(Sp.sparse_gram(df, [], ["o_custkey"], "y", "o_orderkey"), 1.0)
    return model.levels.frame.select("level", F.round("coef", 4).alias("coef"))


# ---- stacking --------------------------------------------------------------------------------------------------

@query("ENS-3 JN-6 PRJ-4", with_wide("""SELECT ID, round(line_X22, 4) AS "line_X22", round(mean_X0, 4) AS "mean_X0", round(mean_X1, 4) AS "mean_X1" FROM preds""", PREDS_WIDE_CTE))
def layer1_matrix(spark, sf):
    long = predictions_long(wide(spark, sf, "ID", "y", "X0", "X1", "X22"))
    m = K.layer1_matrix(long, MODELS).select("ID", *sorted(MODELS))
    return rounded(m, "ID", digits=4)


BLEND = {"mean_X0": 0.627, "mean_X1": 0.143, "line_X22": 0.23}


@query("ENS-6", with_wide("SELECT ID, round(0.627::DOUBLE * mean_X0 + 0.143::DOUBLE * mean_X1 + 0.23::DOUBLE * line_X22, 4) AS y FROM preds", PREDS_WIDE_CTE))
def blend_weighted(spark, sf):
    long = predictions_long(wide(spark, sf, "ID", "y", "X0", "X1", "X22"))
    return K.blend(K.layer1_matrix(long, MODELS), BLEND).select("ID", F.round("y", 4).alias("y"))


@query("ENS-7", with_wide("SELECT ID, round(0.75::DOUBLE * mean_X0 + 0.25::DOUBLE * line_X22, 4) AS y FROM preds", PREDS_WIDE_CTE))
def blend_two(spark, sf):
    long = predictions_long(wide(spark, sf, "ID", "y", "X0", "X1", "X22"))
    two = ["mean_X0", "line_X22"]
    m = K.layer1_matrix(long.filter(F.col("model").isin(two)), two)
    return K.blend(m, {"mean_X0": 0.75, "line_X22": 0.25}).select("ID", F.round("y", 4).alias("y"))


@query("ENS-4 UDF-4 UDF-5")
def stack_chain(spark, sf):
    """Lasso, boosting, a classifier's probabilities and a forest feed one linear model."""
    a, b = halves(spark, sf)
    band = (F.col("y_lin") > 130).cast("int")
    a = L.assemble(a, X, "y_lin").withColumn("band", band)
    b = L.assemble(b, X, "y_lin").withColumn("band", band)
    chain = Pipeline(stages=[
        K.PredictionFeature(LinearRegression(regParam=0.1, elasticNetParam=1.0)),
        K.PredictionFeature(GBTRegressor(maxIter=5, maxDepth=3)),
        K.PredictionFeature(LogisticRegression(labelCol="band", maxIter=10)),
        K.PredictionFeature(RandomForestRegressor(numTrees=10)),
        LinearRegression(regParam=1e-6)])
    out = chain.fit(a).transform(b)
    return rounded(V.regression_metrics(out, "label", "prediction").select("n", "r2", "rmse"), "n", digits=4)


@query("ENS-5 UDF-6")
def super_learner(spark, sf):
    a, b = halves(spark, sf)
    a = a.withColumn("fold", F.expr("cast(ID div 2 % 3 as int)"))
    _, test, _ = K.super_learner(a, b, X, "y_lin", "ID", 3, ["ridge", "lasso", "tree"], "ols")
    return test.select("ID", F.round("pred", 3).alias("pred"))


NESTED_SQL = with_wide("""SELECT ID, model, round(avg(my + wa * (ia + sa * X22 - ma) + wb * (ib + sb * X14 - mb)), 4) AS pred
    FROM wide, w JOIN base ON base.f = w.f AND base.j = w.f WHERE tc = 0 GROUP BY ID, model""",
    "ks AS (SELECT unnest([0, 1, 2]) AS k)",
    """base AS (SELECT f.k AS f, j.k AS j, regr_slope(y_lin, X22) AS sa, regr_intercept(y_lin, X22) AS ia, regr_slope(y_lin, X14) AS sb, regr_intercept(y_lin, X14) AS ib
      FROM wide, ks f, ks j WHERE tc = 1 AND ID // 2 % 3 <> f.k AND ID // 2 % 3 <> j.k GROUP BY ALL)""",
    "z AS (SELECT f, j, y_lin AS y, ia + sa * X22 AS a, ib + sb * X14 AS b FROM wide JOIN base ON j = ID // 2 % 3 WHERE tc = 1 AND f <> j)",
    """m AS (SELECT f, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) * count(*) AS aa, var_pop(b) * count(*) AS bb, covar_pop(a, b) * count(*) AS ab,
      covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS byy FROM z GROUP BY f)""",
    """w AS (SELECT f, model, ma, mb, my, ((bb + l) * ay - ab * byy) / ((aa + l) * (bb + l) - ab * ab) AS wa, ((aa + l) * byy - ab * ay) / ((aa + l) * (bb + l) - ab * ab) AS wb
      FROM m, (SELECT unnest(['ols', 'ridge']) AS model, unnest([0.0::DOUBLE, 1]) AS l))""")


@query("ENS-5 SRH-3 UDF-6", NESTED_SQL)
def nested_lines(spark, sf):
    """Two lines as layer 1, two linear learners on their out-of-fold predictions as layer 2."""
    df = wide(spark, sf, "ID", "tc", "X14", "X22", "y_lin").withColumn("fold", F.expr("cast(ID div 2 % 3 as int)"))
    bases = {"lines": ("ols", ["X22"]), "flag": ("ols", ["X14"])}
    _, preds, _ = K.nested_registry(df.filter("tc = 1"), df.filter("tc = 0"), "y_lin", "ID", 3, bases, ["ols", "ridge"])
    return preds.select("ID", "model", F.round("pred", 4).alias("pred"))


@query("ENS-5 SRH-3 UDF-6 REG-17 REG-22")
def nested_layers(spark, sf):
    """Linear learners and boosting below; extra trees, bagging and ridge over their predictions."""
    a, b = halves(spark, sf)
    a = a.withColumn("fold", F.expr("cast(ID div 2 % 3 as int)"))
    bases = {n: (n, X) for n in ("ridge_cv", "lasso_cv", "omp", "gbt")}
    _, preds, _ = K.nested_registry(a, b, "y_lin", "ID", 3, bases, ["ridge", "extra_trees", "bagging"])
    return preds.select("ID", "model", F.round("pred", 3).alias("pred"))


GATED_SQL = with_wide("""SELECT model, p.ID, round(p.pred, 6) AS pred FROM (
      SELECT 'line_X22' AS model, ID, a + b * X22 AS pred FROM wide JOIN f1 ON ID // 2 % 5 = k WHERE tc = 1
      UNION ALL SELECT 'line_X16', ID, a + b * X16 FROM wide JOIN f2 ON ID // 2 % 5 = k WHERE tc = 1) p
    JOIN wide w ON w.ID = p.ID
    QUALIFY 1 - sum((w.y_lin - p.pred) * (w.y_lin - p.pred)) OVER (PARTITION BY model)
      / (var_pop(w.y_lin) OVER (PARTITION BY model) * count(*) OVER (PARTITION BY model)) > 0.4""",
    *[f"""{n} AS (SELECT k, regr_slope(y_lin, {c}) AS b, regr_intercept(y_lin, {c}) AS a
    FROM wide, (SELECT unnest([0, 1, 2, 3, 4]) AS k) WHERE tc = 1 AND ID // 2 % 5 <> k GROUP BY k)""" for n, c in (("f1", "X22"), ("f2", "X16"))])


@query("SNK-3 SNK-4 ENS-1 EVL-5", GATED_SQL)
def gated_write(spark, sf):
    """Out-of-fold lines in X22 and in X16; only the one whose scores pass the gate is written and read back."""
    train = wide(spark, sf, "ID", "tc", "X16", "X22", "y_lin").filter("tc = 1") \
        .withColumn("fold", F.expr("cast(ID div 2 % 5 as int)"))
    g = G.gram(train, ["X16", "X22"], "y_lin", "fold")
    fitted = {f"line_{c}": [L.from_gram(K.without_fold(g.pick([c], "y_lin"), f), L.ols_solve) for f in range(5)]
              for c in ("X22", "X16")}
    scored = K.score_all(train, fitted, ["ID", "fold", F.col("y_lin").alias("y")], "fold")
    metrics = K.fold_scores(scored)
    path = new_path(spark, "gated")
    Wr.write_gated(scored.select("ID", "model", F.round("oof_pred", 6).alias("pred")), metrics, 0.4, path)
    return spark.read.schema("ID bigint, pred double, model string, score string").option("header", True).csv(path).select("ID", "model", "pred")


@query("SRC-1 SET-1 ENC-1 ENC-2 PRF-1 SET-2 WIN-3 ENS-1 EVL-5 SNK-3 SRH-3")
def gated_predictions(spark, sf):
    """The whole layer-1 job: encode over train and test, prune, fold, fit every linear learner out of fold from one
    pass, keep the test predictions of the models that pass the gate."""
    names = ["X0", "X1", "X2", "X5"]
    df = durable(wide(spark, sf, "ID", "tc", *names, *X, "X18", "y_lin"))
    df, feats = E.prepare(df, names, [*X, "X18"], "ID", F.col("tc") == 1)
    df = durable(df)  # read for the fold cuts, the cross products, the scores and the test rows
    train = contiguous_folds(df.filter("tc = 1"), "ID", 5)
    test = df.filter("tc = 0")
    _, preds, metrics = K.run_registry(train, test, feats, "y_lin", "ID", 5, list(K.GRAM_LEARNERS))
    return Wr.gate(preds, metrics, 0.4).select("ID", "model", F.round("pred", 4).alias("pred"))


@query("SRH-3 UDF-6 EVL-5")
def registry_run(spark, sf):
    a, b = halves(spark, sf)
    a = a.withColumn("fold", F.expr("cast(ID div 2 % 3 as int)"))
    _, _, metrics = K.run_registry(a, b, X, "y_lin", "ID", 3, ["ridge", "lasso", "huber", "ransac", "tree", "gbt"])
    return rounded(metrics, "model", "n", digits=3)


# ---- search ----------------------------------------------------------------------------------------------------

@query("SRH-1 SNK-5 WIN-6")
def grid_search(spark, sf):
    """Number of principal (z) and sparse random (j) components: every trial is scored from one pass."""
    df = vectors(spark, sf).withColumn("fold", (F.col("vec_id") % 5).cast("int"))
    df = D.append_components(D.pca(df, "x", 8).transform(df, "x"), "pca", 8)
    df = D.append_components(D.sparse_projection(WIDTH, 8).transform(df, "x"), "srp", 8)
    names = [f"pca_{i}" for i in range(1, 9)] + [f"srp_{i}" for i in range(1, 9)]
    g = G.gram(df, names, "label", "fold")
    rows = H.grid_trials(g, "label", lambda z, j: names[:z] + names[8:8 + j], lambda m, z, j: L.ridge_solve(m, 1.0),
                         range(1, 9), range(1, 9), stop_above=0.99)
    path = new_path(spark, "grid")
    Wr.log_trials(H.trial_frame(spark, rows), path)
    return rounded(spark.read.parquet(path), "trial", "z", "j")


@query("SRH-2 SMP-6")
def cv_one_se(spark, sf):
    """Ridge penalties on repeated target-stratified folds; the strongest penalty within one standard error wins."""
    k, times = 5, 10
    df = S.stratified_folds(durable(planted(spark, sf).drop("fold")), "ID", "y_lin", k, times, 17)
    # One pass: each row counts in one cell of every repetition, k x times cells in all.
    cell = F.array(*[F.lit((t - 1) * k) + F.col(f"fold_{t}") for t in range(1, times + 1)])
    cells = G.gram(df.select(*X, "y_lin", cell.alias("cell")), X, "y_lin", "cell")
    grams = {t: cells.take_folds({f: (t - 1) * k + f for f in range(k)}) for t in range(1, times + 1)}
    alphas = [0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0]
    rows = H.resampled_trials(grams, alphas, lambda a: lambda m: L.ridge_solve(m, a))
    log = spark.createDataFrame(rows, "config int, alpha double, rep int, fold int, r2 double")
    return rounded(V.one_se_choice(log.withColumn("simple", -F.col("alpha")), "config", "r2", "simple"), "config")


@query("SRH-2 UDF-1 REG-16")
def tune_forest(spark, sf):
    df = durable(planted(spark, sf)).withColumn("fold", (F.col("ID") % 3).cast("int"))
    mtry = ["2", "4", "all"]
    rows = list(zip(mtry, H.tuned_forest(df, X, "y_lin", "ID", "fold", mtry)))
    return rounded(spark.createDataFrame(rows, "mtry string, r2 double"), "mtry", digits=3)


@query("EVL-7 WIN-7 REG-18")
def cv_curve(spark, sf):
    df = durable(planted(spark, sf)).withColumn("fold", (F.col("ID") % 3).cast("int"))
    curve = H.round_curve(df, X, "y_lin", "fold", 3, rounds=10, step=0.3, max_depth=3)
    mean = curve.groupBy("round").agg(F.avg("rmse").alias("rmse")).withColumn("fold", F.lit(0))
    best = V.early_stop(mean, "rmse", 3).select("stop_round", "best_round", F.round("best_metric", 4).alias("best_metric"))
    return best


# ---- small cases of the searches and ensembles that SQL can follow ----------------------------------------------

PREP = ["X0", "X2", "X5"]


@query("UDF-5 ENC-1 ENC-2 PRF-1", with_wide("SELECT w.ID, w.tc, w.X14, " + ", ".join(
    f"{c}_code, count(*) OVER (PARTITION BY w.{c}) AS {c}_freq" for c in PREP) + " FROM wide w" + "".join(
    f""" JOIN (SELECT {c} AS v, CAST(row_number() OVER (ORDER BY {c}) - 1 AS INTEGER) AS {c}_code FROM wide GROUP BY {c}) d{c} ON d{c}.v = w.{c}"""
    for c in PREP)))
def prepared_table(spark, sf):
    out, _ = E.prepare(wide(spark, sf, "ID", "tc", "X14", "X18", *PREP), PREP, ["X14", "X18"], "ID", F.col("tc") == 1)
    return out


@query("LA-10 PRJ-5", two_components_sql("(SELECT avg(X14) AS ma, avg(X22) AS mb, var_pop(X14) AS a, var_pop(X22) AS d, covar_pop(X14, X22) AS b FROM wide WHERE tc = 1)",
                                         "(X14 - ma)", "(X22 - mb)").replace("SELECT ID, round", "SELECT ID, tc, round", 1))
def comps_two(spark, sf):
    df = two_columns(spark, sf)
    return rounded(_components(D.pca(df.filter("tc = 1"), "x", 2), df, 2, df.columns[0:2]), "ID", "tc")


@query("REG-24", with_wide("""SELECT feature, CAST(gain = max(gain) OVER () AS INTEGER)::DOUBLE AS importance FROM (
    SELECT 'X14' AS feature, pow(corr(X14, y_lin), 2) AS gain FROM wide WHERE tc = 1
    UNION ALL SELECT 'X15', pow(corr(X15, y_lin), 2) FROM wide WHERE tc = 1
    UNION ALL SELECT 'X16', pow(corr(X16, y_lin), 2) FROM wide WHERE tc = 1)"""))
def importance_stump(spark, sf):
    a, _ = halves(spark, sf)
    return T.tree(a, ["X14", "X15", "X16"], "y_lin", 1).importances(spark)


@query("REG-19", with_wide(f"""SELECT ID, round(m, 6) AS pred FROM wide JOIN (SELECT X14 AS g, avg(y_lin) AS m FROM wide
    WHERE tc = 1 AND ('0x' || substr(md5(ID || '|0'), 1, 13))::BIGINT >= {int(round(0.2 * (1 << 52)))} GROUP BY X14) ON X14 = g WHERE tc = 0"""))
def gbt_early_stump(spark, sf):
    a, b = halves(spark, sf)
    model = T.boosted(S.holdout(a, "ID", 0.2, 0), ["X14"], "y_lin", rounds=5, max_depth=1, validation="holdout")
    return model.transform(b).select("ID", F.round("pred", 6).alias("pred"))


BAG_STEPS = " + ".join(f"CAST(h >= {int(c * (1 << 52))} AS INTEGER)" for c in POISSON_CDF)


@query("REG-22 SMP-8", with_wide(f"""SELECT ID, round(m, 6) AS pred FROM wide JOIN (SELECT g, avg(m) AS m FROM (
      SELECT bag, X14 AS g, sum(w * y_lin) / sum(w) AS m FROM (SELECT bag, X14, y_lin, {BAG_STEPS} AS w FROM (
        SELECT bag, X14, y_lin, ('0x' || substr(md5(ID || '|' || (1000003 + bag)), 1, 13))::BIGINT AS h
        FROM wide, (SELECT unnest([0, 1, 2]) AS bag) WHERE tc = 1)) GROUP BY bag, X14) GROUP BY g) ON X14 = g WHERE tc = 0"""))
def bagging_stump(spark, sf):
    a, b = halves(spark, sf)
    return T.bagged_trees(a, ["X14"], "y_lin", "ID", bags=3, max_depth=1).transform(b).select("ID", F.round("pred", 6).alias("pred"))


@query("ENS-4 UDF-4", STUMP.replace("round(m, 6)", "round(m, 3)"))
def stack_stump(spark, sf):
    """A tree's prediction put in front of the features of a linear fit."""
    a, b = (L.assemble(d, ["X14"], "y_lin") for d in halves(spark, sf))
    chain = Pipeline(stages=[K.PredictionFeature(DecisionTreeRegressor(maxDepth=1)),
                             LinearRegression(solver="l-bfgs", tol=1e-12, maxIter=500)])
    return chain.fit(a).transform(b).select("ID", F.round("prediction", 3).alias("pred"))


@query("ENS-5", with_wide("""SELECT ID, round(mb + mc * ((SELECT avg(a) FROM f) + (SELECT avg(b) FROM f) * X22), 4) AS pred FROM wide,
    (SELECT regr_slope(y, o) AS mc, regr_intercept(y, o) AS mb FROM (SELECT y_lin AS y, a + b * X22 AS o FROM wide JOIN f ON ID // 2 % 5 = k WHERE tc = 1))
    WHERE tc = 0""", FOLD_LINE))
def super_learner_line(spark, sf):
    df = wide(spark, sf, "ID", "tc", "X22", "y_lin").withColumn("fold", F.expr("cast(ID div 2 % 5 as int)"))
    _, test, _ = K.super_learner(df.filter("tc = 1"), df.filter("tc = 0"), ["X22"], "y_lin", "ID", 5, ["ols"], "ols")
    return test.select("ID", F.round("pred", 4).alias("pred"))


GRID_COLS = ["X14", "X16", "X22"]
GRID_SQL = with_wide("""SELECT CAST(z * 2 + CAST(j > 0 AS INTEGER) AS INTEGER) AS trial, z, j, round(1 - sum(e) / any_value(sst), 6) AS metric FROM (
      SELECT xs.z AS z, j, pow(y_lin - my - sxy / (sxx + j) * (x - mx), 2) AS e, (SELECT var_pop(y_lin) * count(*) FROM wide) AS sst
      FROM xs JOIN tr ON xs.z = tr.z AND xs.fold = tr.k, (SELECT unnest([0, 1000])::INTEGER AS j)) GROUP BY z, j""",
    "xs AS (" + " UNION ALL ".join(f"SELECT {i}::INTEGER AS z, ID % 5 AS fold, {c} AS x, y_lin FROM wide" for i, c in enumerate(GRID_COLS)) + ")",
    """tr AS (SELECT z, k, avg(x) AS mx, avg(y_lin) AS my, covar_pop(y_lin, x) * count(*) AS sxy, var_pop(x) * count(*) AS sxx
       FROM xs, (SELECT unnest([0, 1, 2, 3, 4]) AS k) WHERE fold <> k GROUP BY z, k)""")


@query("SRH-1", GRID_SQL)
def grid_lines(spark, sf):
    df = wide(spark, sf, "ID", *GRID_COLS, "y_lin").withColumn("fold", (F.col("ID") % 5).cast("int"))
    rows = H.grid_trials(G.gram(df, GRID_COLS, "y_lin", "fold"), "y_lin", lambda z, j: [GRID_COLS[z]],
                         lambda m, z, j: L.ridge_solve(m, float(j)), range(3), (0, 1000))
    return rounded(H.trial_frame(spark, rows), "trial", "z", "j")


ONE_SE_ALPHAS = [1.0, 1000.0, 10000.0, 100000.0, 1000000.0]


@query("SRH-2 SMP-6", with_wide(f"""SELECT alpha, round(m, 6) AS mean_r2, round(se, 6) AS se FROM (
      SELECT alpha, avg(r2) AS m, stddev_samp(r2) / sqrt(count(*)) AS se FROM (
        SELECT alpha, k, 1 - sum(pow(y_lin - my - sxy / (sxx + alpha) * (X22 - mx), 2)) / (var_pop(y_lin) * count(*)) AS r2
        FROM wide JOIN tr ON ID % 5 = k, (SELECT unnest([{', '.join(f'{a}::DOUBLE' for a in ONE_SE_ALPHAS)}]) AS alpha) GROUP BY alpha, k) GROUP BY alpha)
    QUALIFY m >= max_by(m - se, m) OVER () ORDER BY alpha DESC LIMIT 1""", FOLD_RIDGE))
def one_se_line(spark, sf):
    df = wide(spark, sf, "ID", "X22", "y_lin").withColumn("fold", (F.col("ID") % 5).cast("int"))
    rows = H.resampled_trials({0: G.gram(df, ["X22"], "y_lin", "fold")}, ONE_SE_ALPHAS, lambda a: lambda m: L.ridge_solve(m, a))
    log = spark.createDataFrame(rows, "config int, alpha double, rep int, fold int, r2 double")
    best = V.one_se_choice(log.withColumn("simple", -F.col("alpha")), "config", "r2", "simple")
    return best.select((-F.col("complexity")).alias("alpha"), F.round("mean_metric", 6).alias("mean_r2"), F.round("se", 6).alias("se"))
