"""Approximate nearest neighbours by largest inner product, over balanced posting lists.

Vectors get one more coordinate that makes all equally long, so that the largest inner product is the smallest
distance. Centroids of that same length are fitted on a bounded sample, where clusters that grow too large are split;
an in-memory graph over them finds the nearest ones. A vector near the border of clusters stands in all of theirs. A
query reads the lists whose centroid is at most so many times as far as the nearest one; that ratio is read off a few
hundred vectors compared with everything, as the least that reaches the recall asked for. Lists are read in waves, the
nearest first: later ones hand on only what reaches the last score so far. Lists are cut into parts of bounded size, so
none grows beyond a task. Equal vectors are one entry with their smallest ids.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from broadloom.llm.common import slices
from broadloom.session import durable

LINKS, LONG_LINKS, BEAM = 16, 4, 48
PART_VECTORS, PART_QUERIES, BLOCK_QUERIES = 4096, 2048, 256
#: Lists of the first wave; each later wave ends at WAVE times as many.
FIRST_LISTS, WAVE = 8, 8
#: Vectors whose neighbours are found exactly, to learn how far a query must look.
TRIED = 256


class CentroidGraph:
    """Nearest centroids by beam search over a graph of nearest-neighbour and a few long links, many queries at once."""

    def __init__(self, centroids: np.ndarray, seed: int = 11):
        self.c = centroids.astype(np.float32)
        k = len(self.c)
        rng = np.random.default_rng(seed)
        links = np.empty((k, min(LINKS, k) + LONG_LINKS), np.int32)
        norms = (self.c * self.c).sum(1)
        for i in range(0, k, 512):
            d = norms[None] - 2 * self.c[i:i + 512] @ self.c.T
            links[i:i + 512, :min(LINKS, k)] = np.argpartition(d, min(LINKS, k) - 1, axis=1)[:, :min(LINKS, k)]
        links[:, min(LINKS, k):] = rng.integers(0, k, (k, LONG_LINKS))
        self.links = links
        self.start = np.unique(rng.integers(0, k, 8)).astype(np.int32)

    def nearest(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances), nearest first, about ``beam`` of them (all, if there are no more); -1 and inf fill up."""
        find = self._all if beam >= len(self.c) else partial(self._search, beam=beam)
        out = [find(x[i:i + 256]) for i in range(0, len(x), 256)]
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])

    def _all(self, x: np.ndarray):
        far = _distances(x, self.c)
        ids = np.argsort(far, axis=1, kind="stable").astype(np.int32)
        return ids, np.take_along_axis(far, ids, 1)

    def _search(self, x: np.ndarray, beam: int):
        x = x.astype(np.float32)
        n, k = len(x), len(self.c)
        beam = min(beam, k)
        seen = np.zeros((n, k), bool)
        ids = np.full((n, beam), -1, np.int32)
        far = np.full((n, beam), np.inf, np.float32)
        open_ = np.zeros((n, beam), bool)
        new = np.broadcast_to(self.start, (n, len(self.start)))
        rows = np.arange(n)[:, None]
        while True:
            fresh = ~seen[rows, new]
            seen[rows, new] = True
            # The same centroid twice among the new ones counts once.
            order = np.argsort(new, axis=1, kind="stable")
            s = np.take_along_axis(new, order, 1)
            twice = np.zeros_like(fresh)
            np.put_along_axis(twice, order[:, 1:], s[:, 1:] == s[:, :-1], 1)
            diff = self.c[new] - x[:, None, :]
            d = np.where(fresh & ~twice, np.sqrt((diff * diff).sum(2)), np.inf)
            all_ids, all_far = np.concatenate((ids, new), 1), np.concatenate((far, d), 1)
            all_open = np.concatenate((open_, np.isfinite(d)), 1)
            best = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
            ids, far, open_ = (np.take_along_axis(a, best, 1) for a in (all_ids, all_far, all_open))
            ids = np.where(np.isfinite(far), ids, -1)
            if not open_.any():
                return ids, far
            # Expand the four nearest unexpanded centroids of each query.
            turn = np.argsort(~open_, axis=1, kind="stable")[:, :4]
            go = np.take_along_axis(open_, turn, 1)
            np.put_along_axis(open_, turn, False, 1)
            at = np.where(go, np.take_along_axis(ids, turn, 1), self.start[0])
            new = self.links[at].reshape(n, -1)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T, 0))


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 16, seed: int = 5) -> np.ndarray:
    """k centroids of vectors of one length, brought to that length themselves.

    After each round but the last few, the largest clusters above 1.4 times the average are split: one of their members
    takes the place of the centroid of the smallest cluster.
    """
    rng = np.random.default_rng(seed)
    x = sample.astype(np.float32)
    length = float(np.sqrt((x * x).sum(1).max())) or 1.0
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for turn in range(rounds):
        near = np.concatenate([(x[i:i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        size = np.bincount(near, minlength=k)
        for j in range(x.shape[1]):
            c[:, j] = np.bincount(near, x[:, j], k)
        norm = np.sqrt((c * c).sum(1))
        dead = norm <= 1e-6 * length
        c[~dead] *= length / norm[~dead, None]
        c[dead] = x[rng.integers(0, len(x), int(dead.sum()))]
        if turn < rounds - 3:
            large = np.flatnonzero(size > 1.4 * len(x) / k)
            large = large[np.argsort(-size[large], kind="stable")][:k // 4]
            for into, out_of in zip(np.argsort(size, kind="stable"), large):
                c[into] = x[rng.choice(np.flatnonzero(near == out_of))]
    return c


@dataclass
class Index:
    entries: DataFrame  # rid, v, first, ids: distinct vectors with their smallest ids
    members: DataFrame  # vec_id, rid: every id that takes part
    postings: DataFrame  # list, rid, v: lists near the border too
    centroids: np.ndarray
    longest: float
    neighbours: int
    ratio: float = float("inf")  # lists at most so many times as far as the nearest one are read
    beam: int = 1  # at most so many lists


def _usable(v: Column, dim: int) -> Column:
    return v.isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(
        v, lambda x: x != 0)


def _lifted(v: np.ndarray, longest: float) -> np.ndarray:
    return np.c_[v, np.sqrt(np.maximum(longest ** 2 - (v * v).sum(1), 0))]


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _assign(sent, ratio, copies, batches):
    """The lists of each vector: all within ``ratio`` of the nearest centroid, at most ``copies``."""
    centroids, longest = sent.value
    graph = CentroidGraph(centroids)
    for batch in slices(batches, 2048):
        if batch.num_rows:
            ids, far = graph.nearest(_lifted(_matrix(batch.column("v"), batch.num_rows), longest))
            ids, far = ids[:, :copies], far[:, :copies]
            row, col = np.nonzero((ids >= 0) & (far <= ratio * far[:, :1] + 1e-9))
            taken = pa.array(row)
            yield pa.record_batch([pa.array(ids[row, col], pa.int32()), batch.column("rid").take(taken), batch.column("v").take(taken)],
                                  names=["list", "rid", "v"])


def _asking(v: np.ndarray, longest: float) -> np.ndarray:
    """Queries at the length of the entries: the order of their neighbours is the same."""
    return np.c_[v * (longest / np.sqrt((v * v).sum(1)))[:, None], np.zeros(len(v))]


def _visit(sent, ratio, beam, batches):
    """The lists within ``ratio`` of each query's nearest one, at most ``beam``, numbered from the nearest."""
    centroids, longest = sent.value
    graph = CentroidGraph(centroids)
    for batch in slices(batches, 1024):
        if batch.num_rows:
            ids, far = graph.nearest(_asking(_matrix(batch.column("v"), batch.num_rows), longest), beam)
            row, col = np.nonzero((ids >= 0) & (far <= ratio * far[:, :1] + 1e-9))
            yield pa.record_batch([pa.array(ids[row, col], pa.int32()), batch.column("rid").take(pa.array(row)), pa.array(col, pa.int32())],
                                  names=["list", "rid", "place"])


def _exact(sent, k, batches):
    """Of what a task reads, the ``k`` entries nearest to each of the few vectors sent."""
    v = sent.value
    top = np.full((len(v), 0), 0.0)
    ids = np.full((len(v), 0), "", object)
    for batch in slices(batches, 2048):
        if batch.num_rows:
            top = np.concatenate((top, v @ _matrix(batch.column("v"), batch.num_rows).T), 1)
            ids = np.concatenate((ids, np.broadcast_to(batch.column("rid").to_numpy(zero_copy_only=False), (len(v), batch.num_rows))), 1)
            best = np.argsort(-top, axis=1, kind="stable")[:, :k]
            top, ids = np.take_along_axis(top, best, 1), np.take_along_axis(ids, best, 1)
    yield pa.record_batch([pa.array(np.repeat(np.arange(len(v)), top.shape[1]), pa.int32()), pa.array(ids.ravel().tolist(), pa.string()),
                           pa.array(top.ravel())], names=["q", "rid", "score"])


def _reach(index: Index, recall: float) -> tuple[float, int]:
    """The ratio, and the most lists, that find ``recall`` of the neighbours of TRIED entries (those of smallest hash)."""
    if recall >= 1:
        return float("inf"), len(index.centroids)
    picked = index.entries.orderBy(F.reverse("rid")).limit(TRIED).select("rid", "v").toArrow().combine_chunks()
    if picked.num_rows < 2:
        return float("inf"), len(index.centroids)
    v, own = _matrix(picked.column("v").combine_chunks(), picked.num_rows), picked.column("rid").to_pylist()
    sc = index.entries.sparkSession.sparkContext
    near = index.entries.select("rid", "v").mapInArrow(partial(_exact, sc.broadcast(v), index.neighbours + 1), "q int, rid string, score double")
    near = near.withColumn("k", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "rid"))).filter(F.col("k") <= index.neighbours + 1)
    near = durable(near.select("q", "rid"))  # at most TRIED x (neighbours + 1) rows
    stands = index.postings.select("list", "rid").join(F.broadcast(near), "rid").toArrow().to_pydict()
    far = _distances(_asking(v, index.longest), index.centroids.astype(np.float64))
    far /= np.maximum(far.min(1, keepdims=True), 1e-12)
    least = {}
    for q, rid, place in zip(stands["q"], stands["rid"], stands["list"]):
        if rid != own[q]:
            least[q, rid] = min(far[q, place], least.get((q, rid), np.inf))
    ratio = float(np.quantile(list(least.values()), recall, method="higher")) * (1 + 1e-6)
    return ratio, min(len(index.centroids), int(1.25 * (far <= ratio).sum(1).max()) + FIRST_LISTS)


def build_index(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", neighbours: int = 20, per_list: int | None = None,
                most_lists: int = 8_192, sample_per_list: int = 24, border: float = 1.08, copies: int = 3, recall: float = 0.96) -> Index:
    """Every usable vector, in the lists near it.

    NULL ids, and vectors that are NULL, all zero, hold NULL, NaN or infinity, or have another length than most, take no
    part. Rows that repeat an id and a vector are one. Centroids come from ``sample_per_list`` vectors a list (those of
    smallest hash), so from at most sample_per_list x most_lists, and travel to the tasks: ``most_lists`` of them at most.
    A list has ``per_list`` vectors on average; by default 4 times the root of their number, at least 512.

    ``recall`` is the share of true neighbours that searches shall find; 1 reads every list and finds all.
    """
    typed = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter(
        "vec_id is not null and v is not null")
    size = typed.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = size["d"] if size else 0
    rows = typed.filter(_usable(F.col("v"), dim)).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # -0.0 is 0.0
    rows = durable(rows.withColumn("rid", F.concat(F.hex(F.xxhash64("v")), F.lit(":"), F.hex(F.xxhash64("v", F.lit(1))))))
    # The smallest ids of each distinct vector; Spark keeps as few per task before the shuffle.
    least = F.row_number().over(W.partitionBy("rid").orderBy("vec_id"))
    small = rows.select("rid", "vec_id").distinct().withColumn("k", least).filter(F.col("k") <= neighbours + 1).groupBy("rid").agg(
        F.min("vec_id").alias("first"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    entries = durable(small.join(rows.groupBy("rid").agg(F.first("v").alias("v")), "rid"))
    # Ids that stand for several vectors belong to several entries.
    members = rows.select("vec_id", "rid").distinct()
    stats = entries.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m")).first()
    n, longest = stats["n"], float(np.sqrt(stats["m"] or 0.0))
    lists = int(min(most_lists, max(1, n // (per_list or max(512, int(4 * n ** 0.5))))))
    picked = entries.orderBy("rid").limit(sample_per_list * lists).select("v").toArrow()
    sample = _matrix(picked.column("v").combine_chunks(), picked.num_rows) if picked.num_rows else np.ones((1, max(dim, 1)))
    centroids = fit_centroids(_lifted(sample, longest), min(lists, len(sample)))
    sent = vectors.sparkSession.sparkContext.broadcast((centroids, longest))
    postings = durable(entries.select("rid", "v").mapInArrow(partial(_assign, sent, border, copies), "list int, rid string, v array<double>"))
    index = Index(entries, members, postings, centroids, longest, neighbours)
    index.ratio, index.beam = _reach(index, recall)
    return index


def _best(neighbours):
    def score(pdf):
        q, p = pdf[pdf.side == 0], pdf[pdf.side == 1]
        out = [pd.DataFrame({"q": np.array([], object), "rid": np.array([], object), "score": np.array([], float)})]
        if len(q) and len(p):
            x, floor, q_ids, p_ids = np.stack(p.v.to_list()), q.floor.to_numpy(), q.rid.to_numpy(), p.rid.to_numpy()
            k = min(neighbours + 1, len(x))
            for i in range(0, len(q), BLOCK_QUERIES):
                s = np.stack(q.v.iloc[i:i + BLOCK_QUERIES].to_list()) @ x.T
                # All that reach the k-th score, so that ties are settled by id later.
                last = np.partition(s, len(x) - k, axis=1)[:, len(x) - k]
                row, col = np.nonzero(s >= np.maximum(last, floor[i:i + BLOCK_QUERIES])[:, None])
                out.append(pd.DataFrame({"q": q_ids[i + row], "rid": p_ids[col], "score": s[row, col]}))
        return pd.concat(out[1:] or out, ignore_index=True)
    return score


def _wave(index: Index, visits: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, rid, score): of each list visited, the best entries that reach the query's floor."""
    sizes = index.postings.groupBy("list").agg(F.count(F.lit(1)).alias("p")).join(visits.groupBy("list").agg(F.count(F.lit(1)).alias("q")), "list")
    sizes = sizes.select("list", F.ceil(F.col("p") / PART_VECTORS).cast("int").alias("ps"), F.ceil(F.col("q") / PART_QUERIES).cast("int").alias("qs"))
    sizes = F.broadcast(durable(sizes))  # at most a row per centroid
    h = F.xxhash64("rid", "list")
    cols = ["list", "i", "j", "side", "rid", "v", "floor"]
    left = visits.join(queries, "rid").join(sizes, "list").withColumn("i", F.pmod(h, "qs").cast("int")).withColumn(
        "j", F.explode(F.expr("sequence(0, ps - 1)"))).withColumn("side", F.lit(0)).select(cols)
    right = index.postings.join(sizes, "list").withColumn("j", F.pmod(h, "ps").cast("int")).withColumn(
        "i", F.explode(F.expr("sequence(0, qs - 1)"))).withColumn("side", F.lit(1)).withColumn("floor", F.lit(0.0)).select(cols)
    return left.union(right).groupBy("list", "i", "j").applyInPandas(_best(index.neighbours), "q string, rid string, score double")


def _waves(index: Index, queries: DataFrame, ratio: float, beam: int) -> DataFrame:
    """(q, rid, score): the best entries of each query in the lists within ``ratio``, and all that tie with the last."""
    sent = queries.sparkSession.sparkContext.broadcast((index.centroids, index.longest))
    visits = durable(queries.mapInArrow(partial(_visit, sent, ratio, beam), "list int, rid string, place int"))
    floored, found, done, end = queries.withColumn("floor", F.lit(float("-inf"))), None, 0, FIRST_LISTS
    best = W.partitionBy("q").orderBy(F.desc("score"))
    while done < beam:
        new = _wave(index, visits.filter(F.col("place").between(done, end - 1)), floored)
        found = (new if found is None else found.union(new)).groupBy("q", "rid").agg(F.max("score").alias("score"))
        found = durable(found.withColumn("k", F.rank().over(best)).filter(F.col("k") <= index.neighbours + 1).drop("k"))
        if end < beam:
            last = found.groupBy("q").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("c")).filter(F.col("c") > index.neighbours)
            # A hair below the last score: sums may be rounded another way.
            floored = queries.join(last.withColumnRenamed("q", "rid"), "rid", "left").select(
                "rid", "v", F.coalesce(F.col("s") - 1e-12 * index.longest ** 2, F.lit(float("-inf"))).alias("floor"))
        done, end = end, end * WAVE
    return found


def search(index: Index, wanted: Column) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of each id that meets ``wanted`` (on vec_id), without itself.

    A query reads the lists within the index's ratio of its nearest one, in waves of 8, 64, 512, ... lists. Ties go to the
    smaller id. A part has some 4096 vectors and 2048 queries of one list at most, and hands on as many entries per query as can still
    matter. Where vectors do not cluster, the ratio leaves many lists, and work grows with queries times vectors.
    """
    asked = durable(index.members.filter(wanted).select(F.col("vec_id").alias("query_id"), "rid").distinct())
    queries = durable(index.entries.join(asked.select("rid").distinct(), "rid", "left_semi").select("rid", "v"))
    found = _waves(index, queries, index.ratio, index.beam)
    if index.ratio < float("inf"):
        # Small lists can leave a query with too few entries: it reads all lists then.
        full = found.groupBy("q").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > index.neighbours).select(F.col("q").alias("rid"))
        short = durable(queries.join(full, "rid", "left_anti"))
        if not short.isEmpty():
            found = found.join(full.withColumnRenamed("rid", "q"), "q", "left_semi").union(
                _waves(index, short, float("inf"), len(index.centroids)))
    named = found.join(index.entries.select("rid", "first", "ids"), "rid")
    close = named.withColumn("k", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "first", "rid"))).filter(
        F.col("k") <= index.neighbours + 1).select("q", F.explode("ids").alias("vec_id"), "score")
    close = close.groupBy("q", "vec_id").agg(F.max("score").alias("score")).withColumn(
        "k", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("k") <= index.neighbours + 1)
    mine = asked.join(close, asked.rid == close.q).filter("query_id <> vec_id")
    last = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return mine.select("query_id", "vec_id", "score").withColumn("rank", F.row_number().over(last)).filter(
        F.col("rank") <= index.neighbours).select("query_id", "rank", "vec_id", "score")
