"""Folds, holdouts and resamples. Every random choice is a seeded hash of the key."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from broadloom.functions.columns import HASH_SPAN, balanced_sum, hash52, hash_fraction_below
from broadloom.operators.lookup import lookup_join
from broadloom.operators.ordering import exact_quantiles, group_index, hash_sample, ordered_index, spread_by
from broadloom.session import durable


def modulo_folds(df: DataFrame, key: str, k: int, name: str = "fold", by_position: bool = False) -> DataFrame:
    """Fold = key mod k, or position in key order mod k."""
    if not by_position:
        return df.withColumn(name, F.pmod(F.col(key), F.lit(k)).cast("int"))
    return ordered_index(df, key, "__i").withColumn(name, F.pmod("__i", F.lit(k)).cast("int")).drop("__i")


def holdout(df: DataFrame, key: str, frac: float, seed: int, name: str = "holdout") -> DataFrame:
    """Mark about ``frac`` of the keys; the choice does not depend on partitioning."""
    return df.withColumn(name, hash_fraction_below(frac, key, seed=seed))


def seeded_holdouts(df: DataFrame, key: str, frac: float, seeds) -> DataFrame:
    """Held-out rows of several seeds, one ``seed`` column. Rows outside every holdout vanish in the map."""
    marks = F.array_compact(F.array(*[
        F.when(hash_fraction_below(frac, key, seed=s), F.lit(s)) for s in seeds]))
    return df.withColumn("seed", F.explode(marks))


def fixed_size(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement."""
    return hash_sample(df, key, n, seed)


def stratified_resample(train: DataFrame, test: DataFrame, level: str, key: str, seed: int) -> DataFrame:
    """Train rows drawn with replacement until each level is as frequent as in test.

    Each test row is one draw, so draws are as distributed as the test table itself. Test rows whose level
    is unknown in train are made up for by train rows drawn without replacement. Adds ``draw``, the test
    key behind a row (NULL for the make-up rows).
    """
    pool = group_index(train, level, key, seed).withColumn("__k", F.struct(level, "idx"))
    sizes = train.groupBy(level).agg(F.count(F.lit(1)).alias("__n"))
    draws = lookup_join(test.select(F.col(key).alias("draw"), level), sizes, level, how="inner")
    draws = draws.select("draw", F.struct(
        level, F.pmod(hash52("draw", seed=seed + 1), F.col("__n")).alias("idx")).alias("__k"))
    # A train row drawn very often is a hot key on the side of the draws, which adaptive execution splits.
    drawn = draws.join(pool, "__k").select("draw", *train.columns)
    missing = test.count() - draws.count()
    if missing <= 0:
        return drawn
    extra = fixed_size(train, key, missing, seed + 2)
    return drawn.unionByName(extra.withColumn("draw", F.lit(None).cast(test.schema[key].dataType)))


def target_bins(df: DataFrame, y: str, bins: int = 5, name: str = "bin") -> DataFrame:
    """Quantile bin of the target; edges are exact and equal edges merge."""
    q = exact_quantiles(df, {y: [i / bins for i in range(1, bins)]})[y]
    edges = sorted({v for v in q.values() if v is not None})
    code = F.lit(0)
    for e in edges:
        code = code + F.when(F.col(y) > F.lit(e), 1).otherwise(0)
    return df.withColumn(name, code.cast("int"))


def stratified_folds(df: DataFrame, key: str, y: str, k: int, times: int, seed: int, bins: int = 5) -> DataFrame:
    """Repeated folds balanced over target bins: columns ``fold_1`` .. ``fold_<times>``.

    All repetitions are ranked together on a narrow (key, bin, repetition) table, so their number adds rows
    but no further shuffles; the tasks of these grow in number with the rows, not in size.
    """
    binned = target_bins(df, y, bins)
    long = durable(binned.select(key, "bin", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("rep")))
    long = group_index(long.withColumn("__rep_bin", F.struct("rep", "bin")), "__rep_bin", key, F.lit(seed) + F.col("rep"), "__i")
    fold = (F.col("__i") % k).cast("int")
    long = spread_by(long.select(key, "rep", "__i"), key, binned.count() * times)
    wide = long.groupBy(key).agg(*[F.max(F.when(F.col("rep") == t, fold)).alias(f"fold_{t}") for t in range(1, times + 1)])
    return binned.join(wide, key)


def with_poisson_weight(df: DataFrame, key: str, bag, seed: int = 0, name: str = "w") -> DataFrame:
    """Bootstrap count of each row in a bag: Poisson(1) by inversion of one seeded hash.

    ``bag`` is a number or a column."""
    bag = F.lit(bag) if isinstance(bag, int) else bag
    u = hash52(key, seed=F.lit(seed * 1_000_003) + bag)
    cuts, cdf, p, j = [], 0.0, math.exp(-1.0), 0
    while p * HASH_SPAN >= 0.5:  # down to the resolution of the hash
        cdf += p
        j += 1
        p /= j
        cuts.append(min(int(cdf * HASH_SPAN), HASH_SPAN))
    # The lambda's variable keeps the hash from being worked out once for every cut.
    steps = F.transform(F.array(u), lambda x: balanced_sum([F.when(x >= F.lit(c), 1.0).otherwise(0.0) for c in cuts]))
    return df.withColumn(name, F.element_at(steps, 1))
