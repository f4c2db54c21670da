"""Global order without a single-task window.

Every operator here cuts the value range into buckets at approximate percentiles, counts the buckets, and
does exact work only inside a bucket. Ranks, quantiles, fold cuts and running totals therefore stay exact
while no task ever sees more than about ``rows_per_bucket`` distinct values.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from broadloom.functions.columns import HASH_SPAN, hash52

ROWS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 16_384
SAMPLE_PER_BUCKET = 64
SAMPLE_VALUES = 2_000_000


TEXT = (T.StringType, T.BinaryType)
SAMPLE_TEXTS_PER_BUCKET = 16


def place(c: Column, kind: T.DataType) -> Column:
    """A double that never falls while the value rises: fit to cut ranges, not to tell values apart. Exact work is done
    on the values themselves, inside a range."""
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    return c.cast("double")


def _kind(df: DataFrame, c: str) -> T.DataType:
    return df.schema[c].dataType


def _bucket_count(n: int, rows_per_bucket: int) -> int:
    return max(1, min(MAX_BUCKETS, math.ceil(n / rows_per_bucket)))


def _bounds(df: DataFrame, cols: list[str], rows_per_bucket: int):
    """Row counts and bucket bounds of every column, two jobs for any number of columns.

    Bounds are quantiles of a hash sample of the distinct values: about ``SAMPLE_PER_BUCKET`` values per
    bucket, gathered as one row each however often they occur. They need not be exact; all later steps are.
    """
    n_row = df.agg(*[F.count(c).alias(f"n_{i}") for i, c in enumerate(cols)]).first()
    counts = {c: n_row[f"n_{i}"] for i, c in enumerate(cols)}
    buckets = {c: _bucket_count(counts[c], rows_per_bucket) for c in cols}
    bounds: dict[str, list[float]] = {c: [] for c in cols}
    for c in [c for c in cols if buckets[c] > 1 and isinstance(_kind(df, c), TEXT)]:
        # Texts are cut at texts: keys with a long common beginning are told apart like any others.
        thin = max(1, counts[c] // (SAMPLE_TEXTS_PER_BUCKET * buckets[c]))
        v = sorted(df.select(F.col(c).cast("binary").alias("v")).filter("v is not null").filter(
            F.pmod(F.xxhash64("v"), F.lit(thin)) == 0).distinct().toArrow().column("v").to_pylist())
        bounds[c] = sorted({v[i] for i in np.linspace(0, len(v), buckets[c] + 1)[1:-1].astype(int)}) if v else []
    todo = [c for c in cols if buckets[c] > 1 and not isinstance(_kind(df, c), TEXT)]
    if todo:
        picks = []
        for c in todo:
            v = place(F.col(c), _kind(df, c))
            # All columns together stay within a bound: with many columns each gives fewer values.
            per_bucket = max(4, min(SAMPLE_PER_BUCKET, SAMPLE_VALUES // sum(buckets[k] for k in todo)))
            thin = max(1, counts[c] // (per_bucket * buckets[c]))
            picks.append(F.when(F.pmod(F.xxhash64(v), F.lit(thin)) == 0,
                                F.struct(F.lit(cols.index(c)).alias("c"), v.alias("v"))))
        sample = df.select(F.explode(F.array_compact(F.array(*picks))).alias("s")).select("s.*") \
                   .filter(F.col("v").isNotNull()).distinct().toArrow()
        which, values = sample.column("c").to_numpy(), sample.column("v").to_numpy()
        for c in todo:
            v = np.sort(values[which == cols.index(c)])
            at = np.linspace(0, len(v), buckets[c] + 1)[1:-1].astype(int) if len(v) else []
            bounds[c] = sorted(set(float(v[i]) for i in at))
    return counts, bounds


def _text_bucket(bounds: list[bytes]):
    @F.arrow_udf("int")
    def bucket(v: pa.Array) -> pa.Array:
        return pa.array([None if x is None else bisect_right(bounds, x) for x in v.to_pylist()], pa.int32())
    return bucket


def with_bucket(df: DataFrame, bounds: dict[str, list], suffix: str = "__b") -> DataFrame:
    """Bucket number of each column: how many of its bounds are at or below the value; -1 for NULL, the last for NaN.
    A column without bounds has one bucket for all."""
    out = df.withColumns({c + suffix: F.lit(0) for c in bounds if not bounds[c]})
    texts = [c for c in bounds if bounds[c] and isinstance(_kind(df, c), TEXT)]
    out = out.withColumns({c + suffix: F.coalesce(_text_bucket(bounds[c])(F.col(c).cast("binary")), F.lit(-1)) for c in texts})
    cut = [c for c in bounds if bounds[c] and c not in texts]
    if cut:
        tmp = {c: f"{c}__d" for c in cut}
        out = out.withColumns({tmp[c]: place(F.col(c), _kind(df, c)) for c in cut})
        out = Bucketizer(
            splitsArray=[[-math.inf, *bounds[c], math.inf] for c in cut],
            inputCols=[tmp[c] for c in cut], outputCols=[c + suffix for c in cut], handleInvalid="keep",
        ).transform(out)
        out = out.withColumns({c + suffix: F.when(F.col(c).isNull(), -1).otherwise(
            F.least(F.col(c + suffix).cast("int"), F.lit(len(bounds[c])))) for c in cut}).drop(*tmp.values())
    return out


def _spread_nulls(df: DataFrame, out: DataFrame, key: str, b: str, rows_per_bucket: int) -> tuple[DataFrame, int]:
    """Rows with a NULL key in buckets -1, -2, ... of bounded size, dealt by a hash of the row; how many there are."""
    parts = _bucket_count(df.filter(F.col(key).isNull()).count(), rows_per_bucket)
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))])
    return out.withColumn(b, F.when(F.col(key).isNull(), (-1 - F.pmod(row, F.lit(parts))).cast("int")).otherwise(F.col(b))), parts


def order_statistics(df: DataFrame, ranks: dict[str, list], rows_per_bucket: int = ROWS_PER_BUCKET):
    """Exact values at 0-based ranks of ordered columns, NULLs left out. Columns of one type keep it; of several types,
    all are compared as doubles.

    ``ranks`` maps a column to a list of ranks or to a function of its row count. Returns
    ``{column: {rank: value}}`` and the row counts. Ties are folded into counts before any ordering, so a
    value that fills a third of the table is still one row.
    """
    cols = list(ranks)
    data = df.select(*cols)
    same = len({_kind(data, c) for c in cols}) == 1
    counts, bounds = _bounds(data, cols, rows_per_bucket)
    want = {c: sorted({r for r in (ranks[c](counts[c]) if callable(ranks[c]) else ranks[c])
                       if 0 <= r < counts[c]}) for c in cols}
    found: dict[str, dict[int, float]] = {c: {} for c in cols}
    if not any(want.values()):
        return found, counts

    long = with_bucket(data, bounds).select(
        F.explode(F.array(*[
            F.struct(F.lit(i).alias("c"), F.col(c + "__b").alias("b"), (F.col(c) if same else F.col(c).cast("double")).alias("v"))
            for i, c in enumerate(cols)])).alias("s")).select("s.*").filter(F.col("v").isNotNull())

    start: dict[tuple[int, int], int] = {}
    if any(bounds[c] for c in cols):
        sizes = long.groupBy("c", "b").count().collect()
        for i in range(len(cols)):
            acc = 0
            for r in sorted((r for r in sizes if r["c"] == i), key=lambda r: r["b"]):
                start[(i, r["b"])] = acc
                acc += r["count"]
    else:
        start = {(i, 0): 0 for i in range(len(cols))}

    targets = {}
    for i, c in enumerate(cols):
        begin = sorted((s, b) for (ci, b), s in start.items() if ci == i)
        for r in want[c]:
            s, b = max(x for x in begin if x[0] <= r)
            targets.setdefault((i, b), []).append(r - s)

    keep = F.lit(False)
    for (i, b) in targets:
        keep = keep | ((F.col("c") == i) & (F.col("b") == b))
    steps = long.filter(keep).groupBy("c", "b", "v").count()
    w = W.partitionBy("c", "b").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    steps = steps.withColumn("hi", F.sum("count").over(w)).withColumn("lo", F.col("hi") - F.col("count"))
    hit = F.lit(False)
    for (i, b), rs in targets.items():
        for r in rs:
            hit = hit | ((F.col("c") == i) & (F.col("b") == b) & (F.col("lo") <= r) & (F.col("hi") > r))
    for row in steps.filter(hit).collect():
        for r in targets[(row["c"], row["b"])]:
            if row["lo"] <= r < row["hi"]:
                found[cols[row["c"]]][start[(row["c"], row["b"])] + r] = row["v"]
    return found, counts


def exact_quantiles(df: DataFrame, probs: dict[str, list[float]], rows_per_bucket: int = ROWS_PER_BUCKET):
    """Exact linearly interpolated quantiles of several columns: ``{column: {p: value or None}}``."""
    def spots(ps):
        return lambda n: [f((n - 1) * p) for p in ps for f in (math.floor, math.ceil)]

    stats, counts = order_statistics(df, {c: spots(ps) for c, ps in probs.items()}, rows_per_bucket)
    out = {}
    for c, ps in probs.items():
        out[c] = {}
        for p in ps:
            if counts[c] == 0:
                out[c][p] = None
                continue
            h = (counts[c] - 1) * p
            lo, hi = float(stats[c][math.floor(h)]), float(stats[c][math.ceil(h)])
            out[c][p] = lo + (hi - lo) * (h - math.floor(h))
    return out


def contiguous_folds(df: DataFrame, key: str, k: int, name: str = "fold",
                     rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """k contiguous blocks of the ordered unique key; the first n mod k blocks are one row longer.

    Only the k-1 cut keys are looked up; the table itself gets its fold in a map, without a shuffle.
    """
    def starts(n):
        q, m = divmod(n, k)
        return [f * q + min(f, m) for f in range(1, k)]

    stats, counts = order_statistics(df, {key: starts}, rows_per_bucket)
    cuts = [stats[key][r] for r in starts(counts[key]) if r in stats[key]]
    return df.withColumn(name, _count_at_or_below(F.col(key), cuts, _kind(df, key)))


def _count_at_or_below(c: Column, cuts, kind: T.DataType) -> Column:
    """Compared in the key's own type, NULL keys before all cuts."""
    return reduce(lambda a, v: a + F.when(c >= F.lit(v).cast(kind), 1).otherwise(0), cuts, F.lit(0)).cast("int")


def rank_slice(df: DataFrame, key: str, first: int, last: int,
               rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Rows whose 0-based rank by the unique key lies in [first, last): two cut keys and a pushed filter."""
    stats, counts = order_statistics(
        df, {key: lambda n: [first, min(last, n) - 1]}, rows_per_bucket)
    n = counts[key]
    if first >= n or last <= first:
        return df.filter(F.lit(False))
    lo, hi = stats[key][first], stats[key][min(last, n) - 1]
    kind = df.schema[key].dataType
    return df.filter(F.col(key).between(F.lit(lo).cast(kind), F.lit(hi).cast(kind)))


def ordered_index(df: DataFrame, key: str, name: str = "idx",
                  rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """0-based global position by a unique key. Rows with a NULL key come first, in any order, however many buckets."""
    _, bounds = _bounds(df.select(key), [key], rows_per_bucket)
    b = key + "__b"
    out = with_bucket(df, bounds)
    if not bounds[key]:
        return out.withColumn(name, F.row_number().over(W.partitionBy(b).orderBy(key)).cast("bigint") - 1).drop(b)
    out, nulls = _spread_nulls(df, out, key, b, rows_per_bucket)
    sizes = {r[b]: r["count"] for r in out.groupBy(b).count().collect()}
    rows, acc = [], 0
    for i in range(-nulls, len(bounds[key]) + 1):
        rows.append((i, acc))
        acc += sizes.get(i, 0)
    offsets = df.sparkSession.createDataFrame(rows, f"{b} int, __o bigint")
    inside = F.row_number().over(W.partitionBy(b).orderBy(key)).cast("bigint") - 1
    return out.withColumn(name, inside).join(F.broadcast(offsets), b).withColumn(
        name, F.col(name) + F.col("__o")).drop(b, "__o")


def running(df: DataFrame, key: str, value: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Running count, sum, mean and maximum of ``value`` in key order; rows with a NULL key come first, in any order."""
    _, bounds = _bounds(df.select(key), [key], rows_per_bucket)
    b = key + "__b"
    out, nulls = with_bucket(df, bounds), 0
    if bounds[key]:
        out, nulls = _spread_nulls(df, out, key, b, rows_per_bucket)
    w = W.partitionBy(b).orderBy(key).rowsBetween(W.unboundedPreceding, 0)
    out = out.withColumns({
        "run_n": F.count(value).over(w), "run_sum": F.sum(value).over(w), "run_max": F.max(value).over(w)})
    if bounds[key]:
        parts = {r[b]: r for r in out.groupBy(b).agg(
            F.count(value).alias("n"), F.sum(value).alias("s"), F.max(value).alias("m")).collect()}
        before, n, s, m = [], 0, 0.0, None
        for i in range(-nulls, len(bounds[key]) + 1):
            before.append((i, n, s, m))
            if i in parts and parts[i]["n"]:
                n, s = n + parts[i]["n"], s + parts[i]["s"]
                m = parts[i]["m"] if m is None else max(m, parts[i]["m"])
        prior = df.sparkSession.createDataFrame(before, f"{b} int, n0 bigint, s0 double, m0 double")
        out = out.join(F.broadcast(prior), b).withColumns({
            "run_n": F.col("run_n") + F.col("n0"),
            "run_sum": F.coalesce(F.col("run_sum"), F.lit(0.0)) + F.col("s0"),
            "run_max": F.greatest("run_max", "m0")}).drop("n0", "s0", "m0")
    return out.withColumn("run_mean", F.try_divide(F.col("run_sum"), F.col("run_n"))).drop(b)


def smallest(df: DataFrame, score: str, tie: str, n: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """The n rows with the smallest (score, tie); a cut value and a filter, never one big sorted limit."""
    stats, counts = order_statistics(df, {score: [n - 1]}, rows_per_bucket)
    if counts[score] <= n:
        return df.filter(F.col(score).isNotNull())
    cut = F.lit(stats[score][n - 1])
    cut = cut.cast(_kind(df, score))
    below = df.filter(F.col(score) < cut)
    at = df.filter(F.col(score) == cut)
    missing = n - below.count()
    if at.limit(missing + 1).count() > missing:
        tied = smallest(at, tie, tie, missing, rows_per_bucket) if score != tie else at.limit(missing)
        return below.unionByName(tied)
    return df.filter(F.col(score) <= cut)


SAMPLE_IN_ONE_TASK = 10_000


def hash_sample(df: DataFrame, key: str, n: int, seed: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """n rows without replacement: those with the smallest seeded hash of the key.

    A hash bound expected to let slightly more than n rows through thins the table in the map; only the few
    that pass are ordered. Should chance let too few through, the exact cut takes over.
    """
    hashed = df.withColumn("__h", hash52(key, seed=seed))
    total = df.select(key).count()
    if total <= n:
        return df
    if n <= SAMPLE_IN_ONE_TASK:
        frac = (n + 6 * math.sqrt(n) + 20) / total
        near = hashed.filter(F.col("__h") < F.lit(int(frac * HASH_SPAN))) if frac < 1 else hashed
        if frac >= 1 or near.select("__h").count() >= n:
            return near.orderBy("__h", key).limit(n).drop("__h")
    return smallest(hashed, "__h", key, n, rows_per_bucket).drop("__h")


LEAST_SLICES = 16


def spread_by(df: DataFrame, key: str, n: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``df`` of ``n`` rows dealt by key over so many tasks that none has many more than ``rows_per_bucket``; small tables stay as they are."""
    parts = _bucket_count(n, rows_per_bucket)
    return df.repartition(parts, key) if parts > LEAST_SLICES else df


def group_index(df: DataFrame, group: str, key: str, seed, name: str = "idx",
                rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """0-based position inside each group in the order of a seeded hash of the key, plus the group size.

    Hash order is uniform, so each group falls into equal hash slices and one group holding a third of the
    table still spreads over many windows.
    """
    parts = max(LEAST_SLICES, _bucket_count(df.select(key).count(), rows_per_bucket))
    step = HASH_SPAN // parts
    out = df.withColumn("__h", hash52(key, seed=seed)) \
            .withColumn("__s", F.expr(f"cast(__h div {step} as int)"))
    if parts > LEAST_SLICES:  # the rows that a task sorts do not grow with the table, whatever the session's shuffles
        out = out.repartition(parts, group, "__s")
    sizes = out.groupBy(group, "__s").agg(F.count(F.lit(1)).alias("__c"))
    w = W.partitionBy(group).orderBy("__s")
    sizes = sizes.withColumn("__o", F.sum("__c").over(w) - F.col("__c")) \
                 .withColumn("group_n", F.sum("__c").over(W.partitionBy(group))) \
                 .drop("__c").withColumnRenamed(group, "__g")
    out = out.join(sizes, F.col(group).eqNullSafe(F.col("__g")) & (out["__s"] == sizes["__s"])) \
             .drop("__g", sizes["__s"])
    inside = F.row_number().over(W.partitionBy(group, "__s").orderBy("__h", key)) - 1
    return out.withColumn(name, (inside + F.col("__o")).cast("bigint")).drop("__h", "__s", "__o")
