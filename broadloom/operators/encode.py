"""Categorical encoding and row-level feature construction."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import DataFrame, functions as F

from broadloom.functions.columns import (
    case_map, extract_number, fingerprint, is_value, longest_run, row_mean, row_sum, safe_log)
from broadloom.operators.lookup import Levels, lookup_join
from broadloom.operators.profile import constant_columns
from broadloom.session import durable

NA_LEVEL = "__NA__"

# Group of a flag triple, and the coefficients of the mined closed-form feature.
TRIPLE_GROUPS = {
    "0_0_0": "Group 1",
    "1_1_1": "Group 2",
    "1_1_0": "Group 2",
    "0_1_1": "Group 2",
    "0_0_1": "Group 3",
    "1_0_1": "Group 4",
    "1_0_0": "Group 4",
}
TRIPLE_DEFAULT = "Group X"
MINED_INTERCEPT = 66.5386547916928
MINED_LINEAR = (25.4051960894959, 7.89681427726105, 4.84424759927184)
MINED_RATIO_TOP = 1.39519609054033
MINED_RATIO_BOTTOM = 0.123227966633056


def label_encode(df: DataFrame, cols, key: str, train=None, levels: Levels | None = None) -> DataFrame:
    """0-based code of each level in sorted order over the whole table."""
    levels = levels or Levels(df, cols, key, train).number()
    return reduce(lambda d, c: levels.attach(d, c, **{f"{c}_code": "code"}), cols, df)


def frequency_encode(df: DataFrame, cols, key: str, train=None, scope: str = "union",
                     levels: Levels | None = None) -> DataFrame:
    """Number of rows sharing the level, over the whole table or over the training rows only."""
    levels = levels or Levels(df, cols, key, train)
    source = {"union": "n", "train": "n_train"}[scope]
    return reduce(lambda d, c: levels.attach(d, c, **{f"{c}_freq": source}), cols, df)


def prepare(df: DataFrame, strings, numbers, key: str, train) -> tuple[DataFrame, list[str]]:
    """Layer-1 preparation over train and test together: label and frequency codes replace the string columns,
    and features constant in train go. Returns the written table and the feature names."""
    levels = Levels(df, strings, key, train).number()
    both = reduce(lambda d, c: levels.attach(d, c, **{f"{c}_code": "code", f"{c}_freq": "n"}), strings, df)
    out = durable(both.drop(*strings))
    features = [*numbers, *[f"{c}_code" for c in strings], *[f"{c}_freq" for c in strings]]
    flat = constant_columns(out.filter(train), features)
    return out.drop(*flat), [c for c in features if c not in flat]


def first_seen_encode(df: DataFrame, cols, key: str, drop: bool = True) -> DataFrame:
    """1-based code by first appearance in key order; the source columns can be dropped."""
    levels = Levels(df, cols, key).number(by="first_key", start=1)
    out = reduce(lambda d, c: levels.attach(d, c, **{f"{c}_code": "code"}), cols, df)
    return out.drop(*cols) if drop else out


def collapse_levels(df: DataFrame, cols, key: str, train, other: str = "other") -> DataFrame:
    """Levels not present in both train and test, and NULL, become ``other``."""
    levels = Levels(df, cols, key, train)
    for c in cols:
        df = levels.attach(df, c, __a="n_train", __b="n_test")
        shared = (F.col("__a") > 0) & (F.col("__b") > 0)
        df = df.withColumn(c, F.when(shared, F.col(c)).otherwise(other)).drop("__a", "__b")
    return df


def na_level(df: DataFrame, cols) -> DataFrame:
    return df.fillna(NA_LEVEL, list(cols))


MAX_DUMMIES = 1_000


def one_hot(df: DataFrame, column: str) -> DataFrame:
    """One 0/1 column per level, in sorted order."""
    levels = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.lit(1).alias("__1")).limit(MAX_DUMMIES + 1).collect()
    if len(levels) > MAX_DUMMIES:
        raise ValueError(f"{column} has more than {MAX_DUMMIES} levels: use one_hot_vector, or sparse_gram to fit on them")
    return df.withColumns({f"{column}_{r[0]}": is_value(column, r[0]) for r in sorted(levels)})


def one_hot_vector(df: DataFrame, column: str, out: str) -> DataFrame:
    """The same as one sparse vector column, for many levels."""
    indexed = StringIndexer(inputCol=column, outputCol="__i", handleInvalid="keep", stringOrderType="alphabetAsc").fit(df)
    encoded = OneHotEncoder(inputCol="__i", outputCol=out, dropLast=False)
    x = indexed.transform(df)
    return encoded.fit(x).transform(x).drop("__i")


def crossed(df: DataFrame, name: str, cols, sep: str = "") -> DataFrame:
    return df.withColumn(name, F.concat_ws(sep, *cols))


def triple_group(df: DataFrame, cols, name: str = "grp") -> DataFrame:
    code = F.concat_ws("_", *[F.col(c).cast("string") for c in cols])
    return df.withColumn(name, case_map(code, TRIPLE_GROUPS, TRIPLE_DEFAULT))


def mined_feature(plus, minus, linear, top, bottom):
    """Closed-form score: intercept + plus + weighted flags + (a + top) / (b + bottom) - minus."""
    total = F.lit(MINED_INTERCEPT) + plus
    for b, c in zip(MINED_LINEAR, linear):
        total = total + F.lit(b) * F.col(c)
    ratio = F.try_divide(F.lit(MINED_RATIO_TOP) + F.col(top), F.lit(MINED_RATIO_BOTTOM) + F.col(bottom))
    return total + ratio - minus


def row_statistics(df: DataFrame, flags) -> DataFrame:
    """flag_sum, consec, row_means and its log, in one projection."""
    return df.withColumns({
        "flag_sum": row_sum(flags), "consec": longest_run(flags),
        "row_means": row_mean(flags), "log_row_means": safe_log(row_mean(flags))})


def group_sums(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    return df.withColumns({name: row_sum(cols) for name, cols in groups.items()})


def augment_labels(train: DataFrame, test: DataFrame, text: str, label: str) -> DataFrame:
    """Train plus those test rows whose label can be read from a printed text."""
    probed = test.withColumn(label, extract_number(text)).filter(F.col(label).isNotNull())
    return train.unionByName(probed.select(*train.columns))


def duplicate_groups(df: DataFrame, features, y: str) -> DataFrame:
    """Groups of rows equal in all features: size, mean and spread of the target, largest first."""
    return df.select(fingerprint(features).alias("hash"), F.col(y).alias("y")).groupBy("hash").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("avg_y"), F.stddev_samp("y").alias("sd_y"),
    ).filter(F.col("n") > 1)


def duplicate_rows(df: DataFrame, features, y: str) -> DataFrame:
    """Every row that has a twin, beside its group's statistics."""
    rows = df.select(fingerprint(features).alias("hash"), F.col(y).alias("y"))
    return lookup_join(rows, duplicate_groups(df, features, y), "hash", how="inner")


def joined_text(df: DataFrame, group: str, item: str, keep, empty: str = "None") -> DataFrame:
    """Kept items of a group, each once, as sorted text; ``empty`` when none is kept. One row per group, however long
    its text: items are made distinct before the shuffle, so a group holds its distinct items only."""
    flagged = df.select(group, F.when(keep, F.col(item)).alias("__i")).groupBy(group, "__i").agg(F.lit(1).alias("__1"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("__i")), lambda v: v.cast("string")), " ")
    return flagged.groupBy(group).agg(text.alias("items")).withColumn(
        "items", F.when(F.col("items") == "", empty).otherwise(F.col("items")))
