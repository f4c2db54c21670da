"""Column profiles, pruning, contingency tables, densities, rules."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from broadloom.functions import columns as C
from broadloom.operators import gram as G, profile as P, rules as U
from broadloom.operators.density import kernel_density
from broadloom.operators.lookup import Levels
from broadloom.plans.fixtures import FLAGS, LEVELS, wide, with_wide
from broadloom.plans.q_relational import MODELS, PREDS_WIDE_CTE, predictions_long
from broadloom.plans.registry import query
from broadloom.session import durable

NUMBERS = ["y", *FLAGS, "X18", "X21", "X22", "X23"]


def _union(cols, template: str) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in cols)


@query("AGG-5 AGG-6 AGG-13", with_wide(f"""SELECT "column", stat, value FROM (SELECT "column",
    count(v)::DOUBLE AS n, (count(*) - count(v))::DOUBLE AS nulls, min(v) AS min, max(v) AS max, round(sum(v), 2) AS sum,
    round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd
    FROM ({_union(NUMBERS, "SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS v FROM wide")}) GROUP BY "column")
    UNPIVOT INCLUDE NULLS (value FOR stat IN (n, nulls, min, max, sum, mean, sd))"""))
def profile_columns(spark, sf):
    s = P.column_stats(wide(spark, sf, *NUMBERS), NUMBERS)
    s = s.withColumns({"sum": F.round("sum", 2), "mean": F.round("mean", 6), "sd": F.round("sd", 6)})
    return P.stats_long(s)


QUARTERS = ["y", "X14", "X22", "X23"]


@query("AGG-6", with_wide(f"""SELECT "column", round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50,
    round(quantile_cont(v, 0.75), 6) AS q75
    FROM ({_union(QUARTERS, "SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS v FROM wide")}) GROUP BY "column" """))
def profile_quartiles(spark, sf):
    out = P.column_quartiles(wide(spark, sf, *QUARTERS), QUARTERS)
    return out.select("column", *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")])


@query("AGG-3 AGG-11", with_wide(f"""SELECT "column", level, count(*) AS n, sum(tc)::BIGINT AS n_train,
    sum(1 - tc)::BIGINT AS n_test, min(ID) AS first_key
    FROM ({_union(LEVELS, "SELECT '{c}' AS \"column\", {c} AS level, tc, ID FROM wide")}) GROUP BY ALL"""))
def value_counts(spark, sf):
    from broadloom.operators.lookup import level_table
    return level_table(wide(spark, sf, "ID", "tc", *LEVELS), LEVELS, "ID", F.col("tc") == 1)


@query("AGG-4 PRF-7", with_wide(f"""SELECT "column", count(DISTINCT level) AS levels, count(DISTINCT level) <= 1 AS single
    FROM ({_union([*LEVELS, "X6"], "SELECT '{c}' AS \"column\", {c} AS level FROM wide WHERE tc = 1")}) GROUP BY "column" """))
def distinct_levels(spark, sf):
    cols = [*LEVELS, "X6"]
    lv = Levels(wide(spark, sf, "ID", "tc", *cols), cols, "ID", F.col("tc") == 1).frame
    single = P.single_level(lv, cols)
    out = lv.filter("n_train > 0").groupBy("column").agg(F.count(F.lit(1)).alias("levels"))
    return out.withColumn("single", F.col("column").isin(single))


@query("PRF-1", with_wide("SELECT ID, X10, X14, X21, X22 FROM wide WHERE tc = 1"))
def drop_constant(spark, sf):
    train = wide(spark, sf, "ID", "tc", "X10", "X14", "X18", "X21", "X22").filter("tc = 1")
    return train.drop(*P.constant_columns(train, ["tc", "X10", "X14", "X18", "X21", "X22"]))


# The SQL counts by itself which columns have too few positives.
@query("PRF-2", with_wide(f"""SELECT "column", v FROM ({_union(["X10", "X14", "X18", "X21"],
    "SELECT ID, '{c}' AS \"column\", {c} AS v FROM wide WHERE tc = 1")}) QUALIFY sum(v) OVER (PARTITION BY "column") >= 20"""))
def drop_rare(spark, sf):
    cols = ["X10", "X14", "X18", "X21"]
    train = wide(spark, sf, "ID", "tc", *cols).filter("tc = 1").drop("tc")
    kept = [c for c in cols if c not in P.rare_flags(train, cols, 20)]
    return train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in kept])).alias("s")).select("s.*")


@query("PRF-3", with_wide("SELECT ID, X10, X11, X12, X20 FROM wide"))
def drop_identical(spark, sf):
    df = wide(spark, sf, "ID", "X10", "X11", "X12", "X19", "X20")
    return df.drop(*[b for _, b in P.identical_columns(df, ["X10", "X11", "X12", "X19", "X20"], "ID")])


@query("PRF-6", with_wide("""SELECT ID, round(line_X22 / 1000, 4) AS "line_X22" FROM preds""", PREDS_WIDE_CTE))
def drop_range(spark, sf):
    long = predictions_long(wide(spark, sf, "ID", "y", "X0", "X1", "X22"))
    m = long.groupBy("ID").pivot("model", MODELS).agg(F.first("pred"))
    m = m.select("ID", F.round(F.col("line_X22") / 1000, 4).alias("line_X22"), "mean_X0",
                 (F.col("mean_X1") * -1).alias("mean_X1"))
    return m.drop(*P.out_of_range(m, ["line_X22", "mean_X0", "mean_X1"]))


CORR = ["X10", "X11", "X12", "X14", "X15", "X18", "X19", "X20", "X22"]


@query("AGG-7 AGG-8", with_wide(f"""SELECT a, b, round(CASE WHEN isnan(r) THEN NULL ELSE r END, 6) AS r FROM (
    {" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM wide"
                        if "X18" not in (a, b) else f"SELECT '{a}', '{b}', NULL" for a in CORR for b in CORR)})"""))
def corr_matrix(spark, sf):
    return G.correlation_frame(wide(spark, sf, *CORR), CORR).withColumn("r", F.round("r", 6))


@query("PRF-4", with_wide("SELECT ID, X10, X11, X12, X14, X22 FROM wide WHERE tc = 0"))
def corr_drop(spark, sf):
    cols = ["X10", "X11", "X12", "X14", "X19", "X20", "X22"]
    df = wide(spark, sf, "ID", "tc", *cols)
    r = G.gram(df.filter("tc = 1"), cols).correlation()
    return df.filter("tc = 0").drop("tc", *P.correlated_columns(r, cols, 0.95))


GREEDY = ["X10", "X11", "X12", "X14", "X19", "X20", "X22"]


# No column lies in more than one pair above the cut here, so each such pair loses the column with the larger mean |r|.
@query("PRF-5", with_wide("""SELECT c AS "column", c IN (SELECT CASE WHEN ma > mb + 1e-9::DOUBLE THEN a ELSE b END FROM hot) AS dropped
    FROM (SELECT DISTINCT a AS c FROM rr)""", f"""rr AS ({" UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) AS r FROM wide"
        for i, a in enumerate(GREEDY) for j, b in enumerate(GREEDY) if a != b)}),
    mean AS (SELECT a AS c, avg(r) AS m FROM rr GROUP BY a),
    hot AS (SELECT a, b, x.m AS ma, y.m AS mb FROM rr JOIN mean x ON x.c = a JOIN mean y ON y.c = b WHERE i < j AND r > 0.9)"""))
def corr_greedy(spark, sf):
    r = G.gram(wide(spark, sf, *GREEDY), GREEDY).correlation()
    dropped = P.greedy_correlation_filter(np.round(r, 9), GREEDY, 0.9)
    return spark.createDataFrame([(c, c in dropped) for c in GREEDY], "column string, dropped boolean")


@query("PRF-8", with_wide("""SELECT ID, round((X10 - m10) / s10, 6) AS X10, round((X22 - m22) / s22, 6) AS X22,
    round((y - my) / sy, 6) AS y FROM wide, (SELECT avg(X10) AS m10, stddev_samp(X10) AS s10, avg(X22) AS m22,
    stddev_samp(X22) AS s22, avg(y) AS my, stddev_samp(y) AS sy FROM wide WHERE tc = 1)"""))
def standardize(spark, sf):
    df = wide(spark, sf, "ID", "tc", "X10", "X18", "X22", "y")
    out = P.standardize(df, ["X10", "X18", "X22", "y"], df.filter("tc = 1"))
    return out.select("ID", *[F.round(c, 6).alias(c) for c in ("X10", "X22", "y")])


@query("PRF-9", with_wide("""SELECT ID, coalesce(X23, (SELECT median(X23) FROM wide WHERE tc = 1)) AS X23,
    coalesce(part, (SELECT median(part) FROM (SELECT CASE WHEN ID % 11 <> 0 THEN y END AS part FROM wide WHERE tc = 1))) AS part
    FROM (SELECT *, CASE WHEN ID % 11 <> 0 THEN y END AS part FROM wide)"""))
def impute_median(spark, sf):
    df = durable(wide(spark, sf, "ID", "tc", "y", "X23").withColumn("part", F.when(F.col("ID") % 11 != 0, F.col("y"))))
    return P.impute_median(df, ["X23", "part"], df.filter("tc = 1")).select("ID", "X23", "part")


@query("AGG-9", with_wide("SELECT X10, X12, count(*) AS n FROM wide GROUP BY X10, X12"))
def crosstab(spark, sf):
    return U.contingency(wide(spark, sf, "X10", "X12"), "X10", "X12")


@query("AGG-10", with_wide("""SELECT X0, X3, n, round(e, 6) AS expected, round((n - e) / sqrt(e), 6) AS residual FROM (
    SELECT X0, X3, coalesce(n, 0) AS n, na * nb / t::DOUBLE AS e FROM
      (SELECT X0, count(*) AS na FROM wide GROUP BY X0) CROSS JOIN (SELECT X3, count(*) AS nb FROM wide GROUP BY X3)
      CROSS JOIN (SELECT count(*) AS t FROM wide) LEFT JOIN (SELECT X0, X3, count(*) AS n FROM wide GROUP BY X0, X3) USING (X0, X3))"""))
def assoc_residual(spark, sf):
    out = U.association_residuals(wide(spark, sf, "X0", "X3"), "X0", "X3")
    return out.select("X0", "X3", "n", F.round("expected", 6).alias("expected"), F.round("residual", 6).alias("residual"))


@query("AGG-16", with_wide(f"""SELECT item, n FROM ({_union(FLAGS, "SELECT '{c}' AS item, sum({c})::BIGINT AS n FROM wide")})
    ORDER BY n DESC, item LIMIT 5"""))
def item_frequency(spark, sf):
    return U.item_frequency(wide(spark, sf, *FLAGS), FLAGS, 5)


def kde_sql(source: str, by: str = "", bw: str = "(SELECT stddev_samp(v) * pow(count(v), -0.2) FROM src)") -> str:
    part = f"{by}, " if by else ""
    return f"""src AS ({source}),
lim AS (SELECT min(v) AS lo, max(v) AS hi, {bw} AS h FROM src),
size AS (SELECT {part}count(v) AS m FROM src {f"GROUP BY {by}" if by else ""}),
grid AS (SELECT {part}m, g, lo + g * (hi - lo) / 199 AS x, h FROM size, lim, (SELECT unnest(range(200))::INTEGER AS g)),
dens AS (SELECT {part}g, any_value(x) AS x, coalesce(sum(exp(-0.5 * pow((x - v) / h, 2))), 0) / (any_value(m) * any_value(h) * sqrt(2 * pi())) AS d
        FROM grid {f"JOIN src USING ({by})" if by else ", src"} GROUP BY {part}g)"""


@query("AGG-15", with_wide("SELECT g, round(x, 3) AS x, round(d * 1e6, 6) AS density FROM dens",
                           kde_sql("SELECT y AS v FROM wide")))
def kde_grid(spark, sf):
    out = kernel_density(wide(spark, sf, "y"), "y", 200)
    return out.select("g", F.round("x", 3).alias("x"), F.round(F.col("density") * 1e6, 6).alias("density"))


@query("ENS-8", with_wide("SELECT model, g, round(x, 3) AS x, round(d * 1e6, 6) AS density FROM dens", PREDS_WIDE_CTE,
                          kde_sql("""SELECT 'mean_X0' AS model, mean_X0 AS v FROM preds UNION ALL
                          SELECT 'mean_X1', mean_X1 FROM preds UNION ALL SELECT 'line_X22', line_X22 FROM preds""",
                                  "model", "2000.0::DOUBLE")))
def kde_by_model(spark, sf):
    long = predictions_long(wide(spark, sf, "ID", "y", "X0", "X1", "X22"))
    out = kernel_density(long, "pred", 200, bandwidth=2000.0, by=("model",))
    return out.select("model", "g", F.round("x", 3).alias("x"), F.round(F.col("density") * 1e6, 6).alias("density"))


# Rows with the same flags are one pattern with a count: at most 256 of them, whatever the table.
LONG_ITEMS = f"pat AS MATERIALIZED (SELECT row_number() OVER () AS ID, * FROM (SELECT {', '.join(FLAGS)}, count(*) AS w FROM wide GROUP BY ALL)),\n" \
    "items AS MATERIALIZED (" + _union(FLAGS, "SELECT ID, '{c}' AS item, w FROM pat WHERE {c} = 1") + ")"
LEAST_SETS, LEAST_RULES = 500, 100  # rows that must hold a set
SETS = LONG_ITEMS + """,
total AS (SELECT sum(w)::BIGINT AS t FROM pat),
one AS MATERIALIZED (SELECT item, sum(w)::BIGINT AS n FROM items GROUP BY item),
sets AS MATERIALIZED (
  SELECT a.item || ',' || b.item AS items, 2 AS size, sum(a.w)::BIGINT AS freq FROM items a JOIN items b ON a.ID = b.ID AND a.item < b.item GROUP BY 1
  UNION ALL SELECT a.item || ',' || b.item || ',' || c.item, 3, sum(a.w)::BIGINT FROM items a JOIN items b ON a.ID = b.ID AND a.item < b.item
    JOIN items c ON c.ID = b.ID AND b.item < c.item GROUP BY 1
  UNION ALL SELECT a.item || ',' || b.item || ',' || c.item || ',' || d.item, 4, sum(a.w)::BIGINT FROM items a JOIN items b ON a.ID = b.ID AND a.item < b.item
    JOIN items c ON c.ID = b.ID AND b.item < c.item JOIN items d ON d.ID = c.ID AND c.item < d.item GROUP BY 1)"""
FREQUENT = f"freq >= {LEAST_SETS}"


@query("RUL-1 ENC-13", with_wide(f"SELECT items, CAST(size AS INTEGER) AS size, freq FROM sets WHERE {FREQUENT}", SETS))
def itemsets(spark, sf):
    sets = U.frequent_sets(wide(spark, sf, "ID", *FLAGS), FLAGS, "ID", LEAST_SETS)
    return sets.filter("size > 1").withColumn("items", F.array_join("items", ","))


@query("RUL-2 ORD-2", with_wide(f"""SELECT items, freq, round(freq / t::DOUBLE, 6) AS support, round(freq / t::DOUBLE /
    (SELECT product(n / t::DOUBLE) FROM one WHERE list_contains(string_split(items, ','), item)), 6) AS lift
    FROM sets, total WHERE {FREQUENT} ORDER BY lift DESC, items LIMIT 10""", SETS))
def itemset_lift(spark, sf):
    df = wide(spark, sf, "ID", *FLAGS)
    out = U.itemset_lift(df, FLAGS, U.frequent_sets(df, FLAGS, "ID", LEAST_SETS).filter("size > 1"))
    return out.select(F.array_join("items", ",").alias("items"), "freq", F.round("support", 6).alias("support"),
                      F.round("lift", 6).alias("lift")).orderBy(F.desc("lift"), "items").limit(10)


NAMED = ["a", "b", "c", "d"]
# Each set once for every item it has, that item as the consequent.
RULES = SETS.replace("AS items, 2 AS size", "AS items, a.item AS a, b.item AS b, NULL AS c, NULL AS d, 2 AS size", 1) \
    .replace("c.item, 3,", "c.item, a.item, b.item, c.item, NULL, 3,", 1).replace("d.item, 4,", "d.item, a.item, b.item, c.item, d.item, 4,", 1) \
    .replace("GROUP BY 1", "GROUP BY ALL") + ",\nr AS (" + " UNION ALL ".join(
        f"SELECT {rhs} AS rhs, concat_ws(',', {', '.join(x for x in NAMED if x != rhs)}) AS lhs, freq FROM sets WHERE {rhs} IS NOT NULL AND freq >= {LEAST_RULES}" for rhs in NAMED) + "),\n" \
    "l AS (SELECT items AS lhs, freq AS nl FROM sets UNION ALL SELECT item, n FROM one)"


@query("RUL-3", with_wide("""SELECT lhs, rhs, round(freq / nl::DOUBLE, 6) AS confidence, round(freq / nl::DOUBLE / (n / t::DOUBLE), 6) AS lift,
    round(freq / t::DOUBLE, 6) AS support FROM r JOIN l USING (lhs) JOIN one ON item = rhs, total WHERE freq / nl::DOUBLE >= 0.8""", RULES))
def rules(spark, sf):
    df = wide(spark, sf, "ID", *FLAGS)
    out = U.rules_of(U.frequent_sets(df, FLAGS, "ID", LEAST_RULES), df.count())
    return out.select("lhs", "rhs", *[F.round(c, 6).alias(c) for c in ("confidence", "lift", "support")])


PAIRS = "pairs AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, sum({a} * {b})::DOUBLE AS n11, sum({a})::DOUBLE AS n1, sum({b})::DOUBLE AS n2, count(*)::DOUBLE AS n FROM wide"
    for i, a in enumerate(FLAGS) for b in FLAGS[i + 1:]) + ")"


@query("RUL-4", with_wide("""SELECT a, b, round(coalesce(1 - (n * n11 - n1 * n2) / nullif(sqrt(n1 * n2 * (n - n1) * (n - n2)), 0), 1), 6) AS d
    FROM pairs""", PAIRS))
def phi_dissimilarity(spark, sf):
    out = U.phi_dissimilarity(U.pair_counts(wide(spark, sf, *FLAGS), FLAGS))
    return out.withColumn("d", F.round("d", 6))


@query("RUL-5", with_wide("""SELECT a, b, sum(fa)::BIGINT AS n1, sum(fb)::BIGINT AS n2 FROM (
      SELECT 'is_F' AS a, 'is_O' AS b, CAST(X2 = 'F' AS INTEGER) AS fa, CAST(X2 = 'O' AS INTEGER) AS fb FROM wide UNION ALL
      SELECT 'is_F', 'is_P', CAST(X2 = 'F' AS INTEGER), CAST(X2 = 'P' AS INTEGER) FROM wide UNION ALL
      SELECT 'is_O', 'is_P', CAST(X2 = 'O' AS INTEGER), CAST(X2 = 'P' AS INTEGER) FROM wide)
    GROUP BY a, b HAVING sum(fa * fb) = 0 AND sum(fa) > 0 AND sum(fb) > 0"""))
def never_together(spark, sf):
    df = wide(spark, sf, "X2", "X10", "X12").select(
        "X10", *[C.is_value("X2", v).alias(f"is_{v}") for v in "FOP"])
    return U.never_together(U.pair_counts(df, ["X10", "is_F", "is_O", "is_P"]))
