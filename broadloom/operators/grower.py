"""Trees grown level by level from histograms of binned columns.

Columns are cut into bins once and written beside target and key; where only sums over rows matter (squared loss, every
row in every tree), rows with the same bins are one row with their number, so that passes do not grow with the table but
with the bins that occur together. A level of all trees under way is one pass: tasks
add up the gradient and the count of their rows per (node, column, bin), the cells are added on the executors, and the
driver reads the splits off them, so its work depends on nodes, columns and bins but not on rows. On top of it: extra
trees (one random threshold per node and column), gradient boosting with squared or Huber loss that can stop on the
R2 of validation rows and go back to its best round, and adaptive boosting.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, replace
from functools import partial, reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from broadloom.operators.flat_trees import FlatModel, FlatTrees, _features, joined
from broadloom.operators.gram import batch_matrix
from broadloom.session import durable

#: Histogram cells of one pass; a level with more nodes takes several.
MOST_CELLS = 1 << 21
#: So many tasks hand their cells to the driver at once; more are added up on the executors first.
FEW_TASKS = 4
#: Rows that are handed to Python as one where passes need single rows: moving them costs more than the work on them.
BLOCK = 64
#: Gains closer than this, relatively, are ties: the first column and bin wins.
TIE = 1e-12


@dataclass
class Bins:
    """Per column the values that stand for its bins, in ascending order; cuts lie midway."""
    cols: list[str]
    values: list[np.ndarray]

    @property
    def cuts(self) -> list[np.ndarray]:
        return [(v[1:] + v[:-1]) / 2 for v in self.values]

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum([0] + [len(v) for v in self.values])

    def raw(self, t: FlatTrees) -> FlatTrees:
        """Thresholds as numbers of the columns instead of bins."""
        cuts = self.cuts
        thresholds = [cuts[f][int(b)] if f >= 0 else 0.0 for f, b in zip(t.feature, t.threshold)]
        return FlatTrees(t.feature, np.array(thresholds, float), t.left, t.right, t.value, t.roots)


def find_bins(df: DataFrame, cols, most: int = 64) -> Bins:
    """A bin per value for columns of about ``most`` values or fewer, else bins of equally many rows: two aggregates."""
    at = [i / most for i in range(most + 1)]
    real = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols]
    counted = df.agg(*[F.approx_count_distinct(c).alias(f"n{i}") for i, c in enumerate(real)]).first()
    # Sets of about ``most`` values each, quantiles of the other columns only.
    got = df.agg(*[(F.collect_set(c) if counted[f"n{i}"] <= most else F.percentile_approx(c, at, 10_000)).alias(f"v{i}")
                   for i, c in enumerate(real)]).first()
    values = [got[f"v{i}"] for i in range(len(real))]
    return Bins(list(cols), [np.unique(np.array(v or [0.0], float)) for v in values])


def _to_bins(bins: Bins):
    """Column with a row's bins, a byte each."""
    cuts, width = bins.cuts, len(bins.cols)

    @F.arrow_udf("binary")
    def to_bins(x: pa.Array) -> pa.Array:
        x = batch_matrix(x, width)
        out = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], 1).astype(np.uint8)
        ends = np.arange(0, out.size + 1, width, dtype=np.int32)
        return pa.Array.from_buffers(pa.binary(), len(out), [None, pa.py_buffer(ends), pa.py_buffer(out.tobytes())])

    return to_bins(_features(bins.cols)).alias("bins")


def binned(df: DataFrame, bins: Bins, y: str, key: str, group=None, alike: bool = False) -> DataFrame:
    """(h, y, grp, f, bins): hashed key, target, 0 for rows to learn from and 1 for validation, score so far, a byte per
    column. NULL and NaN fall into the last bin; rows without a target are left out.

    ``alike``: rows of a group with equal bins are one, ``y`` the mean of their targets, ``w`` their number and ``q`` the
    squares around that mean. Else rows are packed, BLOCK of them in one."""
    group = F.lit(0) if group is None else F.coalesce(group.cast("int"), F.lit(0))
    rows = df.filter(F.col(y).isNotNull()).select(
        F.xxhash64(key).alias("h"), F.col(y).cast("double").alias("y"), group.alias("grp"), F.lit(0.0).alias("f"), _to_bins(bins))
    if not alike:
        return durable(rows.mapInArrow(_packed, "h binary, y binary, grp binary, f binary, bins binary"))
    n = F.count(F.lit(1)).cast("double")
    return durable(rows.groupBy("grp", "bins").agg(F.avg("y").alias("y"), n.alias("w"), (F.var_pop("y") * n).alias("q")).withColumn("f", F.lit(0.0)))


def _ends(column) -> np.ndarray:
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], wide)[column.offset:column.offset + len(column) + 1]


def _raw(column) -> np.ndarray:
    """All bytes of a binary column, a view of Arrow's buffer."""
    ends = _ends(column)
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0]:ends[-1]]


def _blocks(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values.tobytes())])


def _packed(batches, sizes=(("h", 8), ("y", 8), ("grp", 4), ("f", 8))):
    """Blocks of BLOCK rows as one, every column the bytes of its numbers."""
    for batch in batches:
        if batch.num_rows:
            at = np.append(np.arange(0, batch.num_rows, BLOCK), batch.num_rows)
            width = len(_raw(batch.column("bins"))) // batch.num_rows
            out = [_blocks(batch.column(c).to_numpy(), at * size) for c, size in sizes]
            yield pa.record_batch([*out, _blocks(_raw(batch.column("bins")), at * width)], names=[*(c for c, _ in sizes), "bins"])


def _column(batch, name: str, kind=np.float64) -> np.ndarray:
    """A column's numbers, whether rows are packed or not."""
    column = batch.column(name)
    packed = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    return _raw(column).view(kind) if packed else column.to_numpy()


def _places(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with equal bins as one: the first of each, and which of these every row is."""
    sizes = b.max(axis=0).astype(np.int64) + 1
    if np.log2(sizes.astype(float)).sum() >= 62:
        return np.arange(len(b)), np.arange(len(b))
    code = np.zeros(len(b), np.int64)
    for j, size in enumerate(sizes):
        code = code * size + b[:, j]
    _, first, place = np.unique(code, return_index=True, return_inverse=True)
    return first, place


def _uniform(h: np.ndarray, seed: int) -> np.ndarray:
    """Number in [0, 1) of a hashed key, another one for each seed."""
    z = h.view(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)


@dataclass
class _State:
    """What a pass needs: the rounds so far since the scores were last written, and how rows count."""
    done: list[tuple[FlatTrees, float]]
    base: float
    subsample: float
    seed: int
    clip: float = np.inf  # of the gradient: the joint of Huber's loss

    def rows(self, batch):
        """(different bins, which of them each row has, learning rows' mask, residuals, targets)"""
        y, f = _column(batch, "y"), _column(batch, "f")
        b = _raw(batch.column("bins")).reshape(len(y), -1)
        first, place = _places(b)
        b = b[first]
        for trees, step in self.done:
            f = f + (step * trees.value[trees.leaves(b)].sum(1))[place]
        learn = _column(batch, "grp", np.int32) == 0
        if self.subsample < 1:
            learn = learn & (_uniform(_column(batch, "h", np.int64), self.seed) < self.subsample)
        return b, place, learn, y - self.base - f, y

    def numbers(self, batch, b, place, y):
        return _numbers(batch, len(y))


def _numbers(batch, rows: int):
    """(number of rows, squares around their mean) of each row; (1, 0) unless rows alike are one."""
    if "w" not in batch.schema.names:
        return np.ones(rows), np.zeros(rows)
    return batch.column("w").to_numpy(), batch.column("q").to_numpy()


def _histograms(sent, batches):
    """(cell, g, n) of the open nodes; cells -1 to -4 hold what R2 of the validation rows needs."""
    state, growing, slot, starts, slots, judged = sent.value
    g = [np.zeros(slots * int(w)) for w in np.diff(starts)]
    n = [np.zeros_like(a) for a in g]
    score = np.zeros(4)
    for batch in batches:
        if not batch.num_rows:
            continue
        b, place, learn, r, y = state.rows(batch)
        w, q = state.numbers(batch, b, place, y)
        if judged:
            held = _column(batch, "grp", np.int32) == 1
            off, many = y[held] - state.base, w[held]
            score += (many.sum(), (many * off).sum(), (many * off * off + q[held]).sum(), (many * r[held] ** 2 + q[held]).sum())
        r, place, w = w[learn] * np.clip(r[learn], -state.clip, state.clip), place[learn], w[learn]
        rs, ws = np.bincount(place, r, len(b)), np.bincount(place, w, len(b))
        where = slot[growing.leaves(b)]
        for t in range(where.shape[1]):
            mine = np.flatnonzero((where[:, t] >= 0) & (ws > 0))
            for j in range(b.shape[1]):
                cell = where[mine, t] * int(starts[j + 1] - starts[j]) + b[mine, j]
                g[j] += np.bincount(cell, rs[mine], len(g[j]))
                n[j] += np.bincount(cell, ws[mine], len(n[j]))
    cells, gs, ns = [], [], []
    for j in range(len(g)):
        width = int(starts[j + 1] - starts[j])
        some = np.flatnonzero(n[j])
        cells.append(some // width * int(starts[-1]) + int(starts[j]) + some % width)
        gs.append(g[j][some])
        ns.append(n[j][some])
    if judged:
        cells, gs, ns = [*cells, -1 - np.arange(4)], [*gs, score], [*ns, np.zeros(4)]
    yield pa.record_batch([pa.array(np.concatenate(cells).astype(np.int64)), pa.array(np.concatenate(gs)), pa.array(np.concatenate(ns))], names=["cell", "g", "n"])


def _gains(g, n, min_leaf):
    """Gain of each cut between neighbouring bins; -inf where a side is too small."""
    gl, nl = np.cumsum(g)[:-1], np.cumsum(n)[:-1]
    gr, nr = g.sum() - gl, n.sum() - nl
    ok = (nl >= min_leaf) & (nr >= min_leaf)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gl * gl / nl + gr * gr / nr - g.sum() ** 2 / n.sum()
    return np.where(ok, gain, -np.inf)


def draw(seed: int, tree: int, path: int, column: int) -> float:
    """Number in [0, 1) from MD5, so that SQL can follow."""
    return int(hashlib.md5(f"{seed}|{tree}|{path}|{column}".encode()).hexdigest()[:13], 16) / (1 << 52)


class _Growth:
    """Trees under way, in bins."""

    def __init__(self, bins: Bins, trees: int, max_depth: int, min_leaf: int, min_split: int, seed: int, random_cut: bool, share: float):
        self.bins, self.max_depth, self.min_leaf, self.min_split = bins, max_depth, min_leaf, max(2, min_split)
        self.seed, self.random_cut, self.share = seed, random_cut, share
        self.feature, self.left, self.right = [-1] * trees, [-1] * trees, [-1] * trees
        self.cut, self.value = [0.0] * trees, [0.0] * trees
        self.tree, self.path, self.depth = list(range(trees)), [1] * trees, [0] * trees
        self.open = list(range(trees)) if max_depth else []
        self.trees, self.gain = trees, np.zeros(len(bins.cols))

    def flat(self) -> FlatTrees:
        ints = lambda a: np.array(a, np.int32)
        return FlatTrees(ints(self.feature), np.array(self.cut, float), ints(self.left), ints(self.right), np.array(self.value, float),
                         np.arange(self.trees, dtype=np.int32))

    def take(self, nodes: list[int], g: np.ndarray, n: np.ndarray) -> None:
        """Split ``nodes`` by their histograms (node, column and bin)."""
        starts = self.bins.starts
        first = slice(0, starts[1])
        for at, gg, nn in zip(nodes, g, n):
            total, count = gg[first].sum(), nn[first].sum()
            self.value[at] = total / count if count else 0.0
            if count < self.min_split:
                continue
            best = self._best(at, [(gg[a:b], nn[a:b]) for a, b in zip(starts, starts[1:])], total * total / count)
            if best is None:
                continue
            gain, j, b = best
            self.gain[j] += gain
            self.feature[at], self.cut[at] = j, float(b)
            a, e = starts[j], starts[j] + b + 1
            sides = (gg[a:e].sum(), nn[a:e].sum())
            for side, (s, c) in enumerate((sides, (total - sides[0], count - sides[1]))):
                child = len(self.feature)
                (self.right if side else self.left)[at] = child
                for name, v in (("feature", -1), ("left", -1), ("right", -1), ("cut", 0.0), ("value", s / c), ("tree", self.tree[at]),
                                ("path", 2 * self.path[at] + side), ("depth", self.depth[at] + 1)):
                    getattr(self, name).append(v)
                if self.depth[child] < self.max_depth and c >= self.min_split:
                    self.open.append(child)

    def _best(self, at, columns, scale):
        best = None
        wanted = range(len(columns))
        if self.share < 1:
            u = [draw(self.seed, self.tree[at], self.path[at], -1 - j) for j in wanted]
            wanted = sorted(np.argsort(u)[:max(1, int(self.share * len(columns)))])
        for j in wanted:
            g, n = columns[j]
            if len(n) < 2:
                continue
            gains = _gains(g, n, self.min_leaf)
            if self.random_cut:
                there = np.flatnonzero(n)
                lo, hi = there[0], there[-1]
                if lo == hi:
                    continue
                v = self.bins.values[j]
                t = v[lo] + draw(self.seed, self.tree[at], self.path[at], j) * (v[hi] - v[lo])
                b = min(max(int(np.searchsorted(v, t, "right")) - 1, lo), hi - 1)
            else:
                b = int(np.flatnonzero(gains >= gains.max() - TIE * abs(gains.max()))[0]) if np.isfinite(gains.max()) else 0
            gain = gains[b]
            if np.isfinite(gain) and gain > TIE * max(scale, 1e-300) and (best is None or gain > best[0] * (1 + TIE)):
                best = (float(gain), j, b)
        return best


def _added(rows: DataFrame, kernel, sent, alone: bool):
    """Cell, g and n of a pass as arrays; added up on the executors unless its few tasks go to the driver ``alone``."""
    cells = rows.mapInArrow(partial(kernel, sent), "cell bigint, g double, n double")
    if not alone:
        cells = cells.groupBy("cell").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))
    got = cells.toArrow()
    return tuple(got.column(c).to_numpy() for c in ("cell", "g", "n"))


def _grow(rows: DataFrame, growth: _Growth, state: _State, judged: bool = False):
    """All levels; the validation sums of the first pass where ``judged``."""
    sc, starts = rows.sparkSession.sparkContext, growth.bins.starts
    width, sums = int(starts[-1]), None
    alone = rows.rdd.getNumPartitions() <= FEW_TASKS
    while growth.open:
        few = growth.open[:max(1, MOST_CELLS // width)]
        growth.open = growth.open[len(few):]
        slot = np.full(len(growth.feature), -1)
        slot[few] = np.arange(len(few))
        sent = sc.broadcast((state, growth.flat(), slot, starts, len(few), judged and sums is None))
        cell, g, n = _added(rows, _histograms, sent, alone)
        if judged and sums is None:
            sums = np.bincount(-1 - cell[cell < 0], g[cell < 0], 4)
        there = cell >= 0
        grid = np.stack([np.bincount(cell[there], a[there], len(few) * width) for a in (g, n)])
        growth.take(few, *grid.reshape(2, len(few), width))
        sent.unpersist()
    return sums


def importances(spark, cols, gain: np.ndarray) -> DataFrame:
    total = gain.sum() or 1.0
    return spark.createDataFrame([(c, float(v / total)) for c, v in zip(cols, gain)], "feature string, importance double")


def extra_trees(df: DataFrame, cols, y: str, key: str, trees: int = 10, max_depth: int = 12, min_leaf: int = 1, min_split: int = 2,
                share: float = 1.0, bins: int = 64, seed: int = 1) -> FlatModel:
    """Trees over all rows; each node draws one threshold per column between the column's least and greatest value there
    and takes the best of these. A level of all trees is one pass (several beyond MOST_CELLS cells).

    ``share`` of the columns is looked at per node. Nodes without a spread in any column are leaves, as are those of
    fewer than ``min_split`` rows. ``max_depth`` bounds what the driver holds.
    """
    found = find_bins(df.filter(F.col(y).isNotNull()), cols, bins)
    rows = binned(df, found, y, key, alike=True)
    base = df.agg(F.avg(F.col(y).cast("double"))).first()[0] or 0.0
    growth = _Growth(found, trees, max_depth, min_leaf, min_split, seed, True, share)
    _grow(rows, growth, _State([], base, 1.0, seed))
    return FlatModel(found.raw(growth.flat()), np.full(trees, 1 / trees), list(cols), base, info={"gain": growth.gain})


# ---- boosting ------------------------------------------------------------------------------------------------

def _advance(sent, batches):
    state = sent.value
    for batch in batches:
        if batch.num_rows:
            *_, r, y = state.rows(batch)
            f = y - state.base - r
            f = pa.array(f) if "w" in batch.schema.names else _blocks(f, _ends(batch.column("y")) - _ends(batch.column("y"))[0])
            yield batch.set_column(batch.schema.get_field_index("f"), "f", f)


def _residuals(sent, batches):
    """(leaf, r) of the learning rows; leaf 0 of a tree that is not grown yet."""
    state, trees = sent.value
    for batch in batches:
        if batch.num_rows:
            b, place, learn, r, _ = state.rows(batch)
            yield pa.record_batch([pa.array(trees.leaves(b)[place[learn], 0].astype(np.int32)), pa.array(r[learn])], names=["leaf", "r"])


def _beyond(sent, batches):
    """(leaf, d, n) of a task: residuals less their leaf's median, clipped at the joint and added up, and their number."""
    state, trees, medians = sent.value
    d, n = np.zeros(len(medians)), np.zeros(len(medians))
    for batch in batches:
        if batch.num_rows:
            b, place, learn, r, _ = state.rows(batch)
            leaf = trees.leaves(b)[place[learn], 0]
            d += np.bincount(leaf, np.clip(r[learn] - medians[leaf], -state.clip, state.clip), len(d))
            n += np.bincount(leaf, minlength=len(n))
    yield pa.record_batch([pa.array(np.arange(len(d), dtype=np.int32)), pa.array(d), pa.array(n)], names=["leaf", "d", "n"])


def _huber_leaves(rows, growth, state, sent_state) -> None:
    """Leaf values of Huber's loss: the leaf's median plus the mean of what is beyond it, clipped at the joint."""
    sent = sent_state(growth.flat())
    r = rows.mapInArrow(partial(_residuals, sent), "leaf int, r double")
    found = {x.leaf: x.m for x in r.groupBy("leaf").agg(F.percentile_approx("r", 0.5, 100_000).alias("m")).collect()}
    medians = np.array([found.get(leaf, 0.0) for leaf in range(len(growth.feature))], float)
    sent = rows.sparkSession.sparkContext.broadcast((state, growth.flat(), medians))
    means = rows.mapInArrow(partial(_beyond, sent), "leaf int, d double, n double").groupBy("leaf").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    for x in means.collect():  # one row per node
        if x.n:
            growth.value[x.leaf] = medians[x.leaf] + x.d / x.n


def boost(df: DataFrame, cols, y: str, key: str, rounds: int = 100, step: float = 0.1, max_depth: int = 3, loss: str = "squared",
          alpha: float = 0.9, subsample: float = 1.0, share: float = 1.0, min_leaf: int = 1, min_split: int = 2, validation: str | None = None,
          patience: int | None = None, bins: int = 64, seed: int = 1, rewrite_every: int = 25) -> FlatModel:
    """Gradient boosting from the mean (Huber: the median) of the learning rows.

    With a boolean ``validation`` column those rows are only judged, by R2 after each round in the pass that starts the
    next one; after ``patience`` rounds without a strict improvement the fit stops and the model keeps its best round.
    ``info`` has the curve, the best round (from 0) and the round it stopped at.

    ``huber``: gradients are clipped at the ``alpha`` quantile of the absolute residuals of the round, leaves take their
    median plus the clipped mean beyond it; quantiles are mergeable sketches, exact up to 100 000 rows a leaf.
    With squared loss and without ``subsample`` rows with equal bins are one row with their number.
    ``subsample`` rows by hash of key and round, ``share`` columns per node. A round is ``max_depth`` passes, three more
    for ``huber``; every ``rewrite_every`` rounds the scores so far are written, so that a pass walks few trees.
    """
    held = F.col(validation) if validation else None
    learning = df.filter(F.col(y).isNotNull() & (~F.coalesce(held, F.lit(False)) if validation else F.lit(True)))
    found = find_bins(learning, cols, bins)
    rows = binned(df, found, y, key, held, alike=loss == "squared" and subsample >= 1)
    target = F.col(y).cast("double")
    base = learning.agg(F.percentile_approx(target, 0.5, 100_000) if loss == "huber" else F.avg(target)).first()[0] or 0.0
    sc, kept, gain, done, curve = rows.sparkSession.sparkContext, [], np.zeros(len(found.cols)), [], []
    best, stop = -1, rounds - 1

    def judge(sums):
        nonlocal best
        n, s, q, e = sums
        curve.append(float(1 - e / (q - s * s / n)) if n and q - s * s / n > 0 else float("-inf"))
        if best < 0 or curve[-1] > curve[best]:
            best = len(curve) - 1
        return patience is not None and len(curve) - 1 - best >= patience

    for r in range(rounds + bool(validation)):
        last = r == rounds
        state = _State(done, base, subsample, seed + r)
        growth = _Growth(found, 1, 1 if last else max_depth, min_leaf, min_split, seed + r, False, share)
        if loss == "huber" and not last:
            size = rows.mapInArrow(partial(_residuals, sc.broadcast((state, growth.flat()))), "leaf int, r double").agg(
                F.percentile_approx(F.abs("r"), alpha, 100_000)).first()[0]
            state.clip = float(size or 0.0)
        sums = _grow(rows, growth, state, judged=bool(validation) and r > 0)
        if validation and r > 0 and judge(sums):
            stop = r - 1
            break
        if last:
            break
        if loss == "huber" and growth.feature[0] >= 0:
            _huber_leaves(rows, growth, state, lambda flat, s=state: sc.broadcast((s, flat)))
        kept.append(growth.flat())
        gain += growth.gain
        done = [*done, (kept[-1], step)]
        if len(done) >= rewrite_every and r + 1 < rounds:
            rows = durable(rows.mapInArrow(partial(_advance, sc.broadcast(_State(done, base, 1.0, 0))), rows.schema))
            done = []
    size = best + 1 if validation and best >= 0 else len(kept)
    info = {"curve": curve, "best_round": best, "stop_round": stop, "rounds": size, "gain": gain}
    return FlatModel(found.raw(joined(kept[:size])), np.full(size, step), list(cols), base, info=info)


# ---- adaptive boosting ----------------------------------------------------------------------------------------

#: So many different rows (bins and target) are boosted in one task, where a round takes no pass.
ROWS_IN_TASK = 1 << 22
#: Of more, so many are a task of each pass.
ROWS_A_PASS = 1 << 20
#: Beyond, trees are grown on the driver from sums per combination of bins while there are no more of these.
FEW_CELLS = 1 << 16


class _Weighted(_Growth):
    """One tree over rows that count by weights of any size: a side needs a row, however light."""

    def __init__(self, bins: Bins, max_depth: int):
        super().__init__(bins, 1, max_depth, 0, 0, 0, False, 1.0)
        self.min_split = 0

    def _best(self, at, columns, scale):
        best = None
        for j, (g, n) in enumerate(columns):
            there = np.flatnonzero(n)
            if len(there) < 2:
                continue
            g, n = g[there], n[there]
            left, right = (np.cumsum(g)[:-1] ** 2 / np.cumsum(n)[:-1], np.cumsum(g[::-1])[-2::-1] ** 2 / np.cumsum(n[::-1])[-2::-1])
            both = left + right
            gains = both - g.sum() ** 2 / n.sum()
            b = int(np.flatnonzero(gains >= gains.max() - TIE * both.max())[0])
            if gains[b] > TIE * both[b] and (best is None or gains[b] > best[0] * (1 + TIE)):
                best = (float(gains[b]), j, int(there[b]))
        return best


def _grow_cells(growth: _Growth, b: np.ndarray, g: np.ndarray, n: np.ndarray) -> FlatTrees:
    """All levels from sums at hand, per combination of bins."""
    starts, width = growth.bins.starts, b.shape[1]
    slots = int(starts[-1])
    while growth.open:
        few = growth.open[:max(1, MOST_CELLS // slots)]
        growth.open = growth.open[len(few):]
        slot = np.full(len(growth.feature), -1)
        slot[few] = np.arange(len(few))
        where = slot[growth.flat().leaves(b)[:, 0]]
        mine = np.flatnonzero((where >= 0) & (n > 0))
        cell = (where[mine, None] * slots + starts[:-1] + b[mine]).ravel()
        growth.take(few, *(np.bincount(cell, np.repeat(a[mine], width), len(few) * slots).reshape(len(few), slots) for a in (g, n)))
    return growth.flat()


@dataclass
class _Reweighted(_State):
    """Rounds of adaptive boosting since the weights were last written: (tree, greatest error, power of a right row's factor, scale)."""
    past: tuple = ()

    def numbers(self, batch, b, place, y):
        w = _column(batch, "w")
        if self.past:
            trees = joined([t for t, *_ in self.past])
            power = np.zeros(len(w))
            for values, (_, top, p, scale) in zip(np.ascontiguousarray(trees.value[trees.leaves(b)].T), self.past):
                power += p * (1 - np.abs(y - values[place]) / top) + math.log(scale)
            w = w * np.exp(power)
        return w, np.zeros(len(w))

    def rows(self, batch):
        y = _column(batch, "y")
        b = _raw(batch.column("bins")).reshape(len(y), -1)
        first, place = _places(b)
        return b[first], place, np.ones(len(y), bool), y - self.base, y


def _raised(tree: FlatTrees, base: float) -> FlatTrees:
    return replace(tree, value=tree.value + base)


def _errors(tree: FlatTrees, b, place, y) -> np.ndarray:
    return np.abs(y - tree.value[tree.leaves(b)[:, 0]][place])


def _cell_sums(sent, batches):
    """(cell, g, n) of a task: weighted target and weight per combination of bins, numbered as in ``sent``."""
    state, number = sent.value
    g, n = np.zeros(len(number)), np.zeros(len(number))
    for batch in batches:
        if batch.num_rows:
            b, place, _, r, y = state.rows(batch)
            w, _ = state.numbers(batch, b, place, y)
            at = np.array([number[x.tobytes()] for x in b])[place]
            g += np.bincount(at, w * r, len(g))
            n += np.bincount(at, w, len(n))
    some = np.flatnonzero(n)
    yield pa.record_batch([pa.array(some), pa.array(g[some]), pa.array(n[some])], names=["cell", "g", "n"])


def _judged(sent, batches):
    """(top, e, w) of a task: greatest error, weighted errors and weight."""
    state, tree = sent.value
    sums = np.zeros(3)
    for batch in batches:
        if batch.num_rows:
            b, place, _, _, y = state.rows(batch)
            e, (w, _) = _errors(tree, b, place, y), state.numbers(batch, b, place, y)
            sums = np.array([max(sums[0], e.max()), sums[1] + w @ e, sums[2] + w.sum()])
    yield pa.record_batch([pa.array([v]) for v in sums], names=["top", "e", "w"])


def _reweigh(sent, batches):
    state = sent.value
    for batch in batches:
        if batch.num_rows:
            b, place, _, _, y = state.rows(batch)
            w, ends = state.numbers(batch, b, place, y)[0], _ends(batch.column("y"))
            yield batch.set_column(batch.schema.get_field_index("w"), "w", _blocks(w, ends - ends[0]))


class _Here:
    """All rows in this process."""

    def __init__(self, bins: Bins, max_depth: int, base: float, total: float, batches):
        read = [(_raw(x.column("bins")).reshape(x.num_rows, -1), _column(x, "y"), _column(x, "w")) for x in batches if x.num_rows]
        b, self.y, self.w = (np.concatenate(a) for a in zip(*read))
        first, self.place = _places(b)
        self.b, self.bins, self.max_depth, self.base, self.total = b[first], bins, max_depth, base, total

    def grow(self) -> FlatTrees:
        g, n = (np.bincount(self.place, a, len(self.b)) for a in (self.w * (self.y - self.base), self.w))
        return _raised(_grow_cells(_Weighted(self.bins, self.max_depth), self.b, g, n), self.base)

    def judge(self, tree: FlatTrees):
        self.e = _errors(tree, self.b, self.place, self.y)
        return self.e.max(), self.w @ self.e, self.w.sum()

    def advance(self, tree: FlatTrees, top: float, power: float, weight: float) -> None:
        self.w = self.w * (self.total / weight) * np.exp(power * (1 - self.e / top))


class _Spread:
    """Rows in a table: a pass tells a tree's errors, another one (one per level where bins meet in too many combinations)
    grows the next; rows are packed, their weights written every ``rewrite_every`` rounds."""

    def __init__(self, rows: DataFrame, n: int, bins: Bins, max_depth: int, base: float, total: float, rewrite_every: int):
        self.bins, self.max_depth, self.total, self.every = bins, max_depth, total, rewrite_every
        self.state, self.sc = _Reweighted([], base, 1.0, 0), rows.sparkSession.sparkContext
        tasks = max(self.sc.defaultParallelism, n // ROWS_A_PASS)
        self.rows = durable(rows.repartition(tasks).mapInArrow(partial(_packed, sizes=(("y", 8), ("w", 8))), "y binary, w binary, bins binary"))
        self.alone = tasks <= FEW_TASKS
        met = rows.select("bins").distinct().limit(FEW_CELLS + 1).toArrow().column("bins").to_pylist()
        self.cells = sorted(met) if len(met) <= FEW_CELLS else None

    def grow(self) -> FlatTrees:
        growth, base = _Weighted(self.bins, self.max_depth), self.state.base
        if self.cells is None:
            _grow(self.rows, growth, self.state)
            return _raised(growth.flat(), base)
        sent = self.sc.broadcast((self.state, {c: i for i, c in enumerate(self.cells)}))
        cell, *sums = _added(self.rows, _cell_sums, sent, self.alone)
        sent.unpersist()
        b = np.frombuffer(b"".join(self.cells), np.uint8).reshape(len(self.cells), -1)
        return _raised(_grow_cells(growth, b, *(np.bincount(cell, a, len(b)) for a in sums)), base)

    def judge(self, tree: FlatTrees):
        sent = self.sc.broadcast((self.state, tree))
        got = self.rows.mapInArrow(partial(_judged, sent), "top double, e double, w double").toArrow()  # one row per task
        sent.unpersist()
        top, e, w = (got.column(c).to_numpy() for c in ("top", "e", "w"))
        return top.max(), e.sum(), w.sum()

    def advance(self, tree: FlatTrees, top: float, power: float, weight: float) -> None:
        self.state = replace(self.state, past=(*self.state.past, (tree, top, power, self.total / weight)))
        if len(self.state.past) >= self.every:
            sent = self.sc.broadcast(self.state)
            self.rows, self.state = durable(self.rows.mapInArrow(partial(_reweigh, sent), self.rows.schema)), replace(self.state, past=())
            sent.unpersist()


def _r2_rounds(table, rounds: int, rate: float) -> tuple[list[FlatTrees], list[float]]:
    """Trees and their weights; stops at a tree without error, or before one that errs by half."""
    trees, weights = [], []
    for r in range(rounds):
        tree = table.grow()
        top, errors, weight = (float(v) for v in table.judge(tree))
        loss = errors / top / weight if top else 0.0
        if loss <= 0 or (loss >= 0.5 and not trees):
            return [*trees, tree], [*weights, 1.0]
        if loss >= 0.5:
            break
        power = rate * math.log(loss / (1 - loss))
        trees.append(tree), weights.append(-power)
        if r + 1 < rounds:
            table.advance(tree, top, power, weight)
    return trees, weights


def _boost_here(sent, batches):
    bins, max_depth, base, total, rounds, rate = sent.value
    trees, weights = _r2_rounds(_Here(bins, max_depth, base, total, batches), rounds, rate)
    ints = [pa.array([getattr(t, c) for t in trees], pa.list_(pa.int32())) for c in ("feature", "left", "right")]
    reals = [pa.array([getattr(t, c) for t in trees], pa.list_(pa.float64())) for c in ("threshold", "value")]
    yield pa.record_batch([pa.array(np.arange(len(trees), dtype=np.int32)), pa.array(weights), *ints, *reals],
                          names=["round", "weight", "feature", "left", "right", "threshold", "value"])


def boost_r2(rows: DataFrame, bins: Bins, rounds: int, rate: float, max_depth: int, rewrite_every: int) -> tuple[list[FlatTrees], list[float]]:
    """Rounds of AdaBoost.R2 over written rows (bins, y, w): trees in the columns' numbers, and their weights."""
    n, total, base = rows.agg(F.count(F.lit(1)), F.sum("w"), F.sum(F.col("w") * F.col("y")) / F.sum("w")).first()
    if not n:
        raise ValueError("no rows to learn from")
    if n > ROWS_IN_TASK:
        trees, weights = _r2_rounds(_Spread(rows, n, bins, max_depth, base, total, rewrite_every), rounds, rate)
    else:
        sent = rows.sparkSession.sparkContext.broadcast((bins, max_depth, base, total, rounds, rate))
        got = rows.coalesce(1).mapInArrow(partial(_boost_here, sent), "round int, weight double, feature array<int>, left array<int>, "
                                                                      "right array<int>, threshold array<double>, value array<double>").collect()
        got = sorted(got, key=lambda r: r["round"])
        ints = lambda a: np.array(a, np.int32)
        trees = [FlatTrees(ints(r.feature), np.array(r.threshold, float), ints(r.left), ints(r.right), np.array(r.value, float), ints([0])) for r in got]
        weights = [r.weight for r in got]
    return [bins.raw(t) for t in trees], weights


def counted(df: DataFrame, bins: Bins, y: str) -> DataFrame:
    """(bins, y, w): rows with equal bins and target as one with their number. Rows without a number in a column are left
    out, a missing target is an error."""
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    rows = df.filter(reduce(and_, [known(c).isNotNull() for c in bins.cols]))
    target = F.coalesce(known(y), F.raise_error(F.lit(f"a row has no {y}")).cast("double"))
    return rows.select(_to_bins(bins), target.alias("y")).groupBy("bins", "y").agg(F.count(F.lit(1)).cast("double").alias("w"))
