"""Transactions, frequent itemsets, association rules and pair dissimilarities of flag columns."""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from broadloom.operators.gram import gram
from broadloom.session import durable


def transactions(df: DataFrame, flags, key: str) -> DataFrame:
    items = F.array_compact(F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in flags]))
    return df.select(key, items.alias("items"))


def item_counts(df: DataFrame, flags) -> DataFrame:
    """(item, n): one aggregate over all flags."""
    flat = df.agg(*[F.sum((F.col(c) == 1).cast("bigint")).alias(c) for c in flags])
    return flat.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("item"), F.col(c).alias("n")) for c in flags])).alias("s")).select("s.*")


def item_frequency(df: DataFrame, flags, top: int = 50) -> DataFrame:
    return item_counts(df, flags).orderBy(F.desc("n"), "item").limit(top)


#: Patterns of a bitmap block, and counts that a pass keeps per task.
BLOCK_PATTERNS, PASS_CELLS = 8192, 1 << 22


def _blocks(items: int, batches):
    """(bits, w): one bitmap per item over up to BLOCK_PATTERNS patterns, and the patterns' weights."""
    held, weights = [], []

    def block():
        grid = np.frombuffer("".join(held).encode(), np.uint8).reshape(-1, items) - ord("0")
        return pa.record_batch([pa.array([np.packbits(grid.T, axis=1).tobytes()], pa.binary()), pa.array([np.array(weights, "<i8").tobytes()], pa.binary())],
                               names=["bits", "w"])

    for batch in batches:
        for pattern, w in zip(batch.column("pattern").to_pylist(), batch.column("w").to_pylist()):
            held.append(pattern)
            weights.append(w)
            if len(held) == BLOCK_PATTERNS:
                yield block()
                held, weights = [], []
    if held:
        yield block()


def _singles(items: int, batches):
    """(item, n) of single items."""
    total = np.zeros(items)
    for batch in batches:
        for bits, w in zip(batch.column("bits").to_pylist(), batch.column("w").to_pylist()):
            weights = np.frombuffer(w, "<i8").astype(float)
            total += np.unpackbits(np.frombuffer(bits, np.uint8).reshape(items, -1), axis=1, count=len(weights)) @ weights
    yield pa.record_batch([pa.array(np.arange(items, dtype=np.int32)), pa.array(total)], names=["item", "n"])


def _supports(sent, items: int, batches):
    """(set, freq) of parent, a, b for every pair of items that extend the same parent: the bitmaps of the parent's items
    intersected, then one weighted product for all pairs of a block."""
    groups = sent.value
    sums = [np.zeros((len(last), len(last))) for _, last in groups]
    for batch in batches:
        for bits, w in zip(batch.column("bits").to_pylist(), batch.column("w").to_pylist()):
            weights = np.frombuffer(w, "<i8").astype(float)
            grid = np.unpackbits(np.frombuffer(bits, np.uint8).reshape(items, -1), axis=1, count=len(weights)).astype(bool)
            for total, (parent, last) in zip(sums, groups):
                there = np.flatnonzero(grid[list(parent)].all(axis=0)) if len(parent) else np.arange(len(weights))
                if len(there):
                    held = grid[np.ix_(last, there)].astype(float)
                    total += (held * weights[there]) @ held.T
    for total, (parent, last) in zip(sums, groups):
        i, j = np.nonzero(np.triu(total, 1))
        if len(i):
            sets = np.c_[np.repeat([list(parent)], len(i), 0), np.asarray(last)[i], np.asarray(last)[j]].astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1, dtype=np.int32) * sets.shape[1]), pa.array(sets.ravel()))
            yield pa.record_batch([flat, pa.array(total[i, j])], names=["set", "freq"])


def _in_chunks(groups):
    """Parents with their extensions, so many at a time that PASS_CELLS counts hold them (or one alone)."""
    chunk, cells = [], 0
    for parent, last in groups:
        if chunk and cells + len(last) ** 2 > PASS_CELLS:
            yield chunk
            chunk, cells = [], 0
        chunk.append((parent, last))
        cells += len(last) ** 2
    if chunk:
        yield chunk


def frequent_sets(df: DataFrame, flags, key: str, least: int, max_items: int = 4) -> DataFrame:
    """(items sorted, size, freq) of the sets of one to ``max_items`` items that at least ``least`` rows hold.

    Rows with the same flags are one pattern with a weight; tasks turn their patterns into blocks of vertical bitmaps,
    written once, so the table itself is read once. Each level then pairs the frequent sets
    that share all but their last item: the parent's bitmaps intersected, one matrix product per block for all pairs.
    Parents travel to the blocks in chunks of bounded size, so neither the table nor a level of sets has to fit the
    driver; counts are added on the executors. ``key`` plays no part: every row counts once.
    """
    spark = df.sparkSession
    names = sorted(flags)
    pattern = F.concat(*[F.when(F.col(c) == 1, "1").otherwise("0") for c in names])
    patterns = df.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("w"))
    blocks = durable(patterns.mapInArrow(partial(_blocks, len(names)), "bits binary, w binary"))
    singles = blocks.mapInArrow(partial(_singles, len(names)), "item int, n double").groupBy("item").agg(F.sum("n").alias("n"))
    often = {r["item"]: int(r["n"]) for r in singles.filter(F.col("n") >= least).collect()}  # one number per flag
    first = spark.createDataFrame([([names[i]], 1, n) for i, n in sorted(often.items())], "items array<string>, size int, freq bigint")
    if len(often) < 2 or max_items < 2:
        return first
    label = F.array(*[F.lit(c) for c in names])
    levels, groups = [first], [((), sorted(often))]
    for size in range(2, max_items + 1):
        parts = []
        for chunk in _in_chunks(groups):
            sent = spark.sparkContext.broadcast(chunk)
            counted = blocks.mapInArrow(partial(_supports, sent, len(names)), "set array<int>, freq double")
            parts.append(durable(counted.groupBy("set").agg(F.sum("freq").cast("bigint").alias("freq")).filter(F.col("freq") >= least)))
        if not parts:
            break
        level = reduce(DataFrame.unionByName, parts)
        levels.append(level.select(F.transform("set", lambda i: F.element_at(label, i + 1)).alias("items"), F.lit(size).alias("size"), "freq"))
        parents = level.groupBy(F.slice("set", 1, size - 1).alias("p")).agg(F.array_sort(F.collect_list(F.element_at("set", -1))).alias("last"))
        groups = ((tuple(r.p), list(r["last"])) for r in parents.filter(F.size("last") > 1).toLocalIterator())
    return reduce(DataFrame.unionByName, levels)


def rules_of(sets: DataFrame, n: int, min_confidence: float = 0.8) -> DataFrame:
    """Single-consequent rules of frequent sets (which hold all their subsets), strongest lift first."""
    whole = sets.filter("size > 1").select("items", "freq", F.explode("items").alias("rhs"))
    whole = whole.withColumn("lhs", F.array_remove("items", F.col("rhs")))
    left = sets.select(F.col("items").alias("lhs"), F.col("freq").alias("n_lhs"))
    right = sets.filter("size = 1").select(F.element_at("items", 1).alias("rhs"), F.col("freq").alias("n_rhs"))
    confidence = F.col("freq") / F.col("n_lhs")
    return whole.join(left, "lhs").join(right, "rhs").filter(confidence >= min_confidence).select(
        F.array_join("lhs", ",").alias("lhs"), "rhs", confidence.alias("confidence"), (confidence / (F.col("n_rhs") / F.lit(n))).alias("lift"),
        (F.col("freq") / F.lit(n)).alias("support")).orderBy(F.desc("lift"), "lhs", "rhs")


def itemset_lift(df: DataFrame, flags, sets: DataFrame) -> DataFrame:
    """Support of a set over the product of its items' supports. The per-item table has one entry per flag
    column, so it travels as a literal map."""
    counts = {r["item"]: r["n"] for r in item_counts(df, flags).collect()}
    n = df.count()
    share = F.create_map(*[F.lit(v) for c in flags for v in (c, counts[c] / n)])
    product = F.aggregate("items", F.lit(1.0), lambda acc, i: acc * F.element_at(share, i))
    return sets.withColumns({"support": F.col("freq") / F.lit(n),
                             "lift": F.try_divide(F.col("freq") / F.lit(n), product)})


def pair_counts(df: DataFrame, flags) -> DataFrame:
    """(a, b, n11, n1, n2, n) for every flag pair, read off one cross-product pass."""
    n, s, g = gram(df, list(flags)).sums()
    rows = [(a, b, int(round(g[i, j])), int(round(s[i])), int(round(s[j])), int(round(n)))
            for i, a in enumerate(flags) for j, b in enumerate(flags) if i < j]
    return df.sparkSession.createDataFrame(rows, "a string, b string, n11 bigint, n1 bigint, n2 bigint, n bigint")


def phi_dissimilarity(pairs: DataFrame) -> DataFrame:
    """1 - phi; 1 where phi is undefined."""
    d = lambda c: F.col(c).cast("double")
    bottom = F.sqrt(d("n1") * d("n2") * (d("n") - d("n1")) * (d("n") - d("n2")))
    phi = F.try_divide(d("n") * d("n11") - d("n1") * d("n2"), bottom)
    return pairs.select("a", "b", F.coalesce(1 - phi, F.lit(1.0)).alias("d"))


def never_together(pairs: DataFrame) -> DataFrame:
    return pairs.filter((F.col("n11") == 0) & (F.col("n1") > 0) & (F.col("n2") > 0)).select("a", "b", "n1", "n2")


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def association_residuals(df: DataFrame, a: str, b: str, per_chunk: int = 1_000) -> DataFrame:
    """Pearson residual (observed - expected) / sqrt(expected) of every cell, empty cells included.

    Levels of ``b`` travel in chunks of about ``per_chunk``, so neither side needs to fit in one place.
    """
    cells = durable(contingency(df, a, b).filter(F.col(a).isNotNull() & F.col(b).isNotNull()))
    rows = cells.groupBy(a).agg(F.sum("n").alias("na"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("nb"))
    size = cols.agg(F.count(F.lit(1)).alias("k"), F.sum("nb").alias("t")).first()
    chunks = max(1, -(-size["k"] // per_chunk))
    packs = cols.groupBy(F.pmod(F.xxhash64(b), F.lit(chunks)).alias("__h")).agg(F.collect_list(F.struct(b, "nb")).alias("__c"))
    grid = rows.withColumn("__h", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(chunks - 1).cast("bigint")))) \
               .join(packs, "__h").select(a, "na", F.explode("__c").alias("__c")).select(a, "na", "__c.*")
    expected = F.col("na").cast("double") * F.col("nb") / F.lit(float(size["t"] or 1))
    return grid.join(cells, [a, b], "left").select(
        a, b, F.coalesce("n", F.lit(0)).alias("n"), expected.alias("expected"),
        ((F.coalesce("n", F.lit(0)) - expected) / F.sqrt(expected)).alias("residual"))
