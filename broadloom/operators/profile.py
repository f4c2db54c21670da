"""Column profiling and pruning: one pass decides, one select projects."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from broadloom.operators.ordering import exact_quantiles

WIDE_AGGREGATES = 100      # beyond this many outputs Spark leaves whole-stage code generation

_STATS = {
    "n": lambda c: F.count(c).cast("double"),
    "nulls": lambda c: F.sum(c.isNull().cast("double")),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "sum": lambda c: F.sum(c),
    "mean": lambda c: F.avg(c),
    "sd": lambda c: F.stddev_samp(c),
}


def column_stats(df: DataFrame, cols, stats=("n", "nulls", "min", "max", "sum", "mean", "sd")) -> DataFrame:
    """(column, <stats...>): one row per column, from a single aggregate.

    Narrow tables use one flat aggregate. Wide ones are turned into (column, value) rows that are combined
    before the shuffle, so code generation survives hundreds of columns.
    """
    cols = list(cols)
    if len(cols) * len(stats) <= WIDE_AGGREGATES:
        flat = df.agg(*[_STATS[s](F.col(c).cast("double")).alias(f"{s}__{i}")
                        for i, c in enumerate(cols) for s in stats])
        return flat.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), *[F.col(f"{s}__{i}").alias(s) for s in stats])
            for i, c in enumerate(cols)])).alias("s")).select("s.*")
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])).alias("s")).select("s.*")
    return long.groupBy("column").agg(*[_STATS[s](F.col("v")).alias(s) for s in stats])


def column_quartiles(df: DataFrame, cols) -> DataFrame:
    """(column, q25, q50, q75): exact linearly interpolated quartiles, NULL for a column without values."""
    cols = list(cols)
    q = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in cols})
    rows = [(c, *(None if v is None else float(v) for v in q[c].values())) for c in cols]
    return df.sparkSession.createDataFrame(rows, "column string, q25 double, q50 double, q75 double")


def stats_long(stats: DataFrame) -> DataFrame:
    names = [c for c in stats.columns if c != "column"]
    return stats.select("column", F.explode(F.array(*[
        F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in names])).alias("s")).select("column", "s.*")


def constant_columns(train: DataFrame, cols) -> list[str]:
    """Columns of one value without NULLs, or of NULLs alone; compared as text, so that no two keys look the same."""
    long = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in cols])).alias("s"))
    rows = long.groupBy("s.column").agg(F.min("s.v").alias("lo"), F.max("s.v").alias("hi"), F.count(F.lit(1)).alias("n"),
                                        F.count("s.v").alias("k")).collect()
    hit = {r["column"] for r in rows if r["k"] == 0 or (r["lo"] == r["hi"] and r["k"] == r["n"])}
    return [c for c in cols if c in hit or not rows]


def rare_flags(train: DataFrame, cols, least: float = 20) -> list[str]:
    rows = column_stats(train, cols, ("sum",)).collect()
    hit = {r["column"] for r in rows if r["sum"] is None or r["sum"] < least}
    return [c for c in cols if c in hit]


def out_of_range(df: DataFrame, cols, low: float = -100, high: float = 1000) -> list[str]:
    rows = column_stats(df, cols, ("min", "max")).collect()
    hit = {r["column"] for r in rows if r["min"] is not None and (r["min"] < low or r["max"] > high)}
    return [c for c in cols if c in hit]


def single_level(levels: DataFrame, cols) -> list[str]:
    """Categorical columns with at most one level in the training rows of a level table."""
    n = {r["column"]: r["k"] for r in levels.filter(F.col("n_train") > 0).groupBy("column").agg(
        F.count(F.lit(1)).alias("k")).collect()}
    return [c for c in cols if n.get(c, 0) <= 1]


def identical_columns(df: DataFrame, cols, key: str) -> list[tuple[str, str]]:
    """(kept, dropped) pairs of equal columns.

    One pass folds each column into two order-free checksums over (key, value); only columns whose sums
    agree are then compared value by value.
    """
    cols = list(cols)
    as_text = {c: F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in cols}
    cells = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), *[F.xxhash64(F.lit(s), F.col(key), as_text[c]).alias(f"s{s}") for s in (1, 2)])
        for i, c in enumerate(cols)])).alias("s")).select("s.*")
    sums = cells.groupBy("i").agg(F.bit_xor("s1").alias("s1"), F.bit_xor("s2").alias("s2")).collect()
    groups: dict[tuple, list[str]] = {}
    for r in sorted(sums, key=lambda r: r["i"]):
        groups.setdefault((r["s1"], r["s2"]), []).append(cols[r["i"]])
    pairs = [(g[0], d) for g in groups.values() for d in g[1:]]
    if not pairs:
        return []
    equal = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), (as_text[a] == as_text[b]).alias("e")) for i, (a, b) in enumerate(pairs)])).alias("s"))
    ok = {r["i"] for r in equal.groupBy("s.i").agg(F.bool_and("s.e").alias("e")).filter("e").collect()}
    return [p for i, p in enumerate(pairs) if i in ok]


def correlated_columns(corr, cols, cut: float = 0.95) -> list[str]:
    """Later column of each pair whose signed correlation reaches the cut (all pairs, p x p on the driver)."""
    drop = {cols[j] for i, j in combinations(range(len(cols)), 2) if corr[i][j] >= cut}
    return [c for c in cols if c in drop]


def greedy_correlation_filter(corr, cols, cut: float = 0.9) -> list[str]:
    """Visit pairs above |cut| from the column with the largest mean |r| down; drop the one of the pair with the
    larger mean |r|, the later column when the means are equal up to rounding noise."""
    import numpy as np

    a = np.abs(np.nan_to_num(np.array(corr, dtype=float)))
    np.fill_diagonal(a, np.nan)
    alive = np.ones(len(cols), bool)
    order = np.argsort(-np.round(np.nanmean(a, axis=1), 9), kind="stable")
    dropped = []
    for pos, i in enumerate(order):
        for j in order[pos + 1:]:
            if not alive[i]:
                break
            if alive[j] and a[i, j] > cut:
                live = alive.copy()
                mean_i = np.nanmean(a[i][live])
                mean_j = np.nanmean(a[j][live])
                lose = max(i, j) if abs(mean_i - mean_j) < 1e-9 else i if mean_i > mean_j else j
                alive[lose] = False
                dropped.append(cols[lose])
    return dropped


def standardize(df: DataFrame, cols, train: DataFrame | None = None) -> DataFrame:
    """Drop zero-variance columns, then centre and scale the rest with the training moments."""
    rows = {r["column"]: r for r in column_stats(train if train is not None else df, cols, ("mean", "sd")).collect()}
    flat = [c for c in cols if not rows[c]["sd"]]
    return df.drop(*flat).withColumns({
        c: (F.col(c) - F.lit(rows[c]["mean"])) / F.lit(rows[c]["sd"]) for c in cols if c not in flat})


def impute_median(df: DataFrame, cols, train: DataFrame | None = None) -> DataFrame:
    """Replace NULL by the exact training median."""
    q = exact_quantiles(train if train is not None else df, {c: [0.5] for c in cols})
    return df.fillna({c: q[c][0.5] for c in cols if q[c][0.5] is not None})
