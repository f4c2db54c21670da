"""Toxicity scores from a factorization machine over hashed terms.

A document is the set of its distinct lower-cased words, hashed into a fixed number of buckets. The score is
``sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>)``: weights add up as in a linear model, and factors let two terms
count together more than apart. It is trained in one task on a bounded number of labelled documents (a
parameter); every document is then scored whole where it lies.

Terms take part that tell the labels apart, alone or in a pair with one of the terms nearest to doing so.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from broadloom.llm.common import worker_state
from broadloom.session import durable

BUCKETS = 1 << 18
WORDS_KEPT = 300_000
#: Bytes: letters and digits of ASCII, and everything beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class _Buckets(dict):
    """Bucket of a word, remembered for frequent ones; forgets everything when full."""

    def __missing__(self, word):
        if len(self) >= WORDS_KEPT:
            self.clear()
        b = self[word] = xxhash.xxh3_64_intdigest(word) % BUCKETS
        return b


def terms(text: bytes | None) -> np.ndarray:
    """Sorted distinct buckets of the words of a UTF-8 text."""
    words = set(WORD.findall((text or b"").lower()))
    return np.unique(np.fromiter(map(worker_state("toxic_buckets", _Buckets).__getitem__, words), np.int32, len(words)))


def _terms_of(batches):
    for batch in batches:
        yield pa.record_batch([batch.column("label"), batch.column("h"), pa.array(
            [terms(t).tobytes() for t in batch.column("text").to_pylist()], pa.binary())], names=["label", "h", "terms"])


class FactorizationMachine:
    """Second-order machine on binary features; dense arrays over the buckets, float32."""

    def __init__(self, rank: int = 4, epochs: int = 40, rate: float = 0.2, l2: float = 1e-5, batch: int = 64,
                 least_docs: int = 2, seed: int = 7, suspects: int = 4096, max_pairs: int = 8_000_000):
        self.rank, self.epochs, self.rate, self.l2, self.batch, self.least, self.seed = rank, epochs, rate, l2, batch, least_docs, seed
        self.suspects, self.max_pairs = suspects, max_pairs

    def fit(self, rows: list[np.ndarray], y: np.ndarray) -> "FactorizationMachine":
        rng = np.random.default_rng(self.seed)
        self.learnt_from = len(rows), sum(map(len, rows))  # documents, terms
        seen = np.zeros(BUCKETS, np.int32)
        for r in rows:
            seen[r] += 1
        known = self._telling(rows, y, seen)
        place = np.full(BUCKETS, -1, np.int32)
        place[known] = np.arange(len(known))
        rows = [x[x >= 0] for x in (place[r] for r in rows)]
        p = float(y.mean()) if len(y) else 0.0
        p = min(max(p, 1e-3), 1 - 1e-3)
        bias, self.place = np.log(p / (1 - p)), place
        w = np.zeros(len(known), np.float32)
        v = rng.normal(0, 0.01, (len(known), self.rank)).astype(np.float32)
        gw, gv = np.full_like(w, 1e-2), np.full_like(v, 1e-2)
        if 0 < y.sum() < len(y):
            for _ in range(self.epochs):
                for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // self.batch)):
                    bias = self._step([rows[i] for i in part], y[part], bias, w, v, gw, gv)
        self.bias, self.w, self.v = float(bias), w, v
        return self

    def _telling(self, rows, y, seen):
        """Terms whose occurrence depends on the label: log-likelihood ratio above what the best of as many
        independent terms would reach by chance. The many others would only memorise single documents."""
        bad = np.zeros(BUCKETS, np.float64)
        for r, label in zip(rows, y):
            if label:
                bad[r] += 1
        tried, p, n = np.flatnonzero(seen >= self.least), max(float(y.sum()), 0.5), max(len(y), 1)
        a, c = bad[tried], seen[tried].astype(np.float64)
        cells = ((a, c * p / n), (c - a, c * (n - p) / n), (p - a, (n - c) * p / n), (n - p - c + a, (n - c) * (n - p) / n))
        g = sum(2 * np.where(o > 0, o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9)), 0) for o, e in cells)
        alone = tried[g >= 2 * np.log(max(len(tried), 2))]
        return np.union1d(alone, self._in_pairs(rows, y, seen, bad, tried[np.argsort(-g, kind="stable")[:self.suspects]]))

    def _in_pairs(self, rows, y, seen, bad, suspects):
        """Terms of pairs, one of them among ``suspects``, that go with label 1 more than the stronger term alone does.

        Pairs are gathered from documents of label 1 until ``max_pairs`` of them are held; those met five times are
        counted in all documents. A pair passes beyond what the best of as many pairs would reach by chance.
        """
        fit, suspect, gathered = seen >= self.least, np.zeros(BUCKETS, bool), []
        suspect[suspects] = True

        def pairs(r):
            r = r[fit[r]].astype(np.int64)
            a = r[suspect[r]]
            low, high = np.minimum(a[:, None], r), np.maximum(a[:, None], r)
            once = (a[:, None] != r) & ~(suspect[r] & (r < a[:, None]))
            return low[once] * BUCKETS + high[once]

        room = self.max_pairs
        for r, label in zip(rows, y):
            if label and int(fit[r].sum()) * int(suspect[r].sum()) <= room:
                gathered.append(pairs(r))
                room -= len(gathered[-1])
        if not gathered:
            return suspects[:0]
        keys, met = np.unique(np.concatenate(gathered), return_counts=True)
        gathered.clear()
        keys = keys[met >= 5]
        n, k = np.zeros(len(keys)), np.zeros(len(keys))
        a, b = keys // BUCKETS, keys % BUCKETS
        partners = np.zeros(BUCKETS, bool)
        partners[a] = partners[b] = True
        for r, label in zip(rows, y):
            r = r[partners[r]].astype(np.int64)
            few = r[suspect[r]]
            for i in range(0, len(few), 64):  # a long document at a time would be too many
                x = few[i:i + 64, None]
                once = (x != r) & ~(suspect[r] & (r < x))
                pair = np.minimum(x, r)[once] * BUCKETS + np.maximum(x, r)[once]
                at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
                hit = at[keys[at] == pair] if len(keys) else at[:0]
                n[hit] += 1
                k[hit] += label
        p = np.maximum(np.maximum(bad[a] / seen[a], bad[b] / seen[b]), max(float(y.mean()), 1e-6))
        p, n = np.minimum(p, 1 - 1e-6), np.maximum(n, 1)
        g = 2 * (k * np.log(np.maximum(k, 1e-9) / (n * p)) + (n - k) * np.log(np.maximum(n - k, 1e-9) / (n * (1 - p))))
        telling = (k > n * p) & (g >= 2 * np.log(max(int(met.size), 2)))
        return np.union1d(a[telling], b[telling])

    def _step(self, rows, y, bias, w, v, gw, gv):
        sizes = np.array([len(r) for r in rows])
        idx = np.concatenate(rows) if rows else np.empty(0, np.int64)
        doc = np.repeat(np.arange(len(rows)), sizes)
        z, s = self._raw(idx, doc, len(rows), bias, w, v)
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y).astype(np.float32)
        used, back = np.unique(idx, return_inverse=True)
        g = np.bincount(back, err[doc], len(used)).astype(np.float32)
        dw = g / len(rows) + self.l2 * w[used]
        ev = err[doc, None] * (s[doc] - v[idx])
        dv = np.stack([np.bincount(back, ev[:, f], len(used)) for f in range(self.rank)], 1) / len(rows) + self.l2 * v[used]
        gw[used] += dw * dw
        gv[used] += dv * dv
        w[used] -= self.rate * dw / np.sqrt(gw[used])
        v[used] -= self.rate * dv / np.sqrt(gv[used])
        return bias - self.rate * 0.1 * err.mean()

    def _raw(self, idx, doc, n, bias, w, v):
        f = v[idx]
        s = np.stack([np.bincount(doc, f[:, k], n) for k in range(v.shape[1])], 1)
        q = np.bincount(doc, (f * f).sum(1), n)
        return bias + np.bincount(doc, w[idx], n) + 0.5 * ((s * s).sum(1) - q), s

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        kept = [x[x >= 0] for x in (self.place[r] for r in rows)]
        doc = np.repeat(np.arange(len(kept)), [len(r) for r in kept])
        idx = np.concatenate(kept) if kept else np.empty(0, np.int64)
        z, _ = self._raw(idx, doc, len(kept), self.bias, self.w, self.v)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column | None = None, doc_id: str = "doc_id", text: str = "text",
                 label: str = "toxic", max_docs: int = 40_000, max_terms: int = 12_000_000, **params) -> FactorizationMachine:
    """Train on at most ``max_docs`` labelled documents (those of smallest hash of the id), taken whole.

    ``learn`` is a condition on the labels' rows. ``max_terms`` bounds what the fitting task gathers: about 50 MB of
    bucket numbers; the document that would exceed it and all after it (in hash order) are left out. NULL labels
    and ids are skipped. Without labels of both kinds the score is the share of label 1.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    known = known.filter(learn) if learn is not None else known
    # The id decides, so every row of a document falls in or out together; at most max_docs small rows.
    picked = known.groupBy(F.col(doc_id).alias("id")).agg(F.max(F.col(label).cast("int")).alias("label")).orderBy(
        F.xxhash64("id"), "id").limit(max_docs)
    few = picked.sparkSession.createDataFrame(picked.toArrow(), picked.schema)
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("text")).join(F.broadcast(few), "id").select(
        "label", F.xxhash64("id").alias("h"), "text").mapInArrow(_terms_of, "label int, h bigint, terms binary")
    texts = durable(texts)
    sizes = texts.select("h", (F.length("terms") / 4).alias("n")).orderBy("h").limit(max_docs).toArrow()
    total = np.cumsum(sizes.column("n").to_numpy())
    if len(total) and total[-1] > max_terms:
        texts = texts.filter(F.col("h") < int(sizes.column("h").to_numpy()[np.searchsorted(total, max_terms, "right")]))

    def fit(pdf):
        pdf = pdf.sort_values(["h", "terms"])
        m = FactorizationMachine(**params).fit([np.frombuffer(t, np.int32) for t in pdf.terms], pdf.label.to_numpy().astype(np.float32))
        return pdf.__class__({"docs": [m.learnt_from[0]], "terms": [m.learnt_from[1]], "bias": [m.bias], "place": [m.place.tobytes()], "w": [m.w.tobytes()], "v": [m.v.tobytes()]})

    # One group of a bounded sample: its memory is a task's, not the driver's.
    learnt = durable(texts.limit(max_docs).groupBy().applyInPandas(
        fit, "docs long, terms long, bias double, place binary, w binary, v binary")).first()
    model = FactorizationMachine(**params)
    if learnt is None:
        return model.fit([], np.empty(0, np.float32))
    model.bias, model.place = learnt["bias"], np.frombuffer(bytes(learnt["place"]), np.int32)
    model.learnt_from = learnt["docs"], learnt["terms"]
    model.w = np.frombuffer(bytes(learnt["w"]), np.float32)
    model.v = np.frombuffer(bytes(learnt["v"]), np.float32).reshape(-1, model.rank)
    return model


def score_toxicity(docs: DataFrame, model: FactorizationMachine, text: str = "text", name: str = "toxicity") -> DataFrame:
    """``docs`` plus the score (0 to 1) of each whole text; a NULL or empty text gets the model's bias alone.

    The model is at most BUCKETS x (rank + 1) numbers and travels once per executor. Rows stay where they are. A
    column that already bears ``name`` is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.place, model.w, model.v))
    rank = model.rank

    @F.pandas_udf("double")
    def score(texts):
        m = FactorizationMachine(rank)
        m.bias, m.place, m.w, m.v = sent.value
        return texts.__class__(m.score([terms(t) for t in texts]).astype(float))

    return docs.withColumn(name, score(F.col(text).cast("binary")))
