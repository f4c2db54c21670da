"""Dictionaries of column levels and joins against them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from broadloom.session import durable

SMALL_ROWS = 20_000
SMALL_BYTES = 32 << 20


def settle(df: DataFrame, max_rows: int = SMALL_ROWS, max_bytes: int = SMALL_BYTES):
    """Evaluate a dictionary. Returns (frame, is_small).

    At most ``max_rows`` + 1 rows reach the driver. A dictionary within both bounds comes back as a local
    relation, fit for broadcasting; a larger one is written to the checkpoint folder and stays distributed.
    """
    head = df.limit(max_rows + 1).toArrow()
    if head.num_rows <= max_rows and head.nbytes <= max_bytes:
        return df.sparkSession.createDataFrame(head), True
    return durable(df), False


def lookup_join(df: DataFrame, dictionary: DataFrame, on: str, how: str = "left", max_rows: int = SMALL_ROWS) -> DataFrame:
    """Join a unique-key dictionary to a table that may be badly skewed on the key; the table is read once.

    Small dictionaries are broadcast. A larger one is an ordinary join: adaptive execution splits the partitions of hot
    and of NULL keys on the table's side, as the dictionary has one row per key.
    """
    d, small = settle(dictionary, max_rows)
    return df.join(F.broadcast(d) if small else d, on, how)


def level_table(df: DataFrame, cols, key: str, train=None) -> DataFrame:
    """(column, level, n, n_train, n_test, first_key) of all the columns in one pass.

    ``train`` is a boolean column; NULL levels are left out.
    """
    train = F.lit(True) if train is None else train
    long = df.select(F.col(key).alias("k"), train.alias("t"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in cols])).alias("s"))
    return long.select("k", "t", "s.*").filter(F.col("level").isNotNull()).groupBy("column", "level").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("t").cast("bigint")).alias("n_train"),
        F.sum((~F.col("t")).cast("bigint")).alias("n_test"),
        F.min("k").alias("first_key"))


def dense_codes(levels: DataFrame, by: str = "level", name: str = "code", start: int = 0,
                max_window: int = 1_000_000) -> DataFrame:
    """Number the levels of each column in sorted order.

    The window runs over distinct levels only. A column with more than ``max_window`` of them is cut into
    value ranges of about that many first and numbered range by range.
    """
    sizes = {r["column"]: r["count"] for r in levels.groupBy("column").count().collect()}
    if max(sizes.values(), default=0) <= max_window:
        w = W.partitionBy("column").orderBy(by, "level")
        return levels.withColumn(name, (F.row_number().over(w) - 1 + start).cast("int"))
    # As many value ranges per column as it needs, cut at quantiles of a hash sample of about 64 levels per range.
    cuts = {}
    for c, n in sizes.items():
        ranges = -(-n // max_window)
        if ranges > 1:
            thin = max(1, n // (64 * ranges))
            v = sorted(r[0] for r in levels.filter((F.col("column") == c) & (F.pmod(F.xxhash64("level"), F.lit(thin)) == 0)).select(by).collect())
            cuts[c] = sorted({v[len(v) * i // ranges] for i in range(1, ranges)}) if v else []
    bucket = F.lit(0)
    for c, at in cuts.items():
        bucket = F.when(F.col("column") == c, _tree(F.col(by), at)).otherwise(bucket)
    levels = levels.withColumn("__b", bucket)
    sizes = levels.groupBy("column", "__b").count()
    sizes = sizes.withColumn("__o", F.sum("count").over(W.partitionBy("column").orderBy("__b")) - F.col("count"))
    w = W.partitionBy("column", "__b").orderBy(by, "level")
    return levels.join(sizes.drop("count"), ["column", "__b"]).withColumn(
        name, (F.row_number().over(w) - 1 + F.col("__o") + start).cast("int")).drop("__b", "__o")


def _tree(c, cuts, base: int = 0):
    """Number of cuts at or below the value, as a balanced CASE."""
    if not cuts:
        return F.lit(base)
    m = len(cuts) // 2
    return F.when(c < F.lit(cuts[m]), _tree(c, cuts[:m], base)).otherwise(_tree(c, cuts[m + 1:], base + m + 1))


class Levels:
    """The level table of several columns, evaluated once and then joined as often as needed."""

    def __init__(self, df: DataFrame, cols, key: str, train=None, max_rows: int = SMALL_ROWS):
        self.max_rows = max_rows
        self.frame, self.small = settle(level_table(df, cols, key, train), max_rows)

    def number(self, by: str = "level", name: str = "code", start: int = 0) -> "Levels":
        if self.small:
            w = W.partitionBy("column").orderBy(by, "level")
            self.frame = self.frame.withColumn(name, (F.row_number().over(w) - 1 + start).cast("int"))
        else:
            self.frame = dense_codes(self.frame, by, name, start)
        return self

    def attach(self, df: DataFrame, column: str, **values: str) -> DataFrame:
        """Left-join the named level attributes of one column: ``attach(df, "X0", X0_code="code")``."""
        d = self.frame.filter(F.col("column") == column).select(
            F.col("level").alias(column), *[F.col(v).alias(k) for k, v in values.items()])
        return df.join(F.broadcast(d) if self.small else d, column, "left")
