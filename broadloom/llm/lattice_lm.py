"""Subword lattice likelihood of whole texts.

The pieces of an existing subword vocabulary span a lattice over each word (in UTF-8, with the blank before it; every
byte is a piece too, so no word is impossible). The probability of a word is the sum over all its segmentations, by a
forward recursion in log space. Piece weights start from the vocabulary's own scores and are re-estimated on the distinct
words of the training documents by expectation maximisation, each word once, as the lattice has to foretell new words.
Training words are arcs of their own, across the whole word, with their share of the corpus; the lattice of pieces gets
the share of words seen once. Frequent words have one share for each group of training documents (languages, say),
and a text's probability is summed over the groups, which nobody tells the scorer. A text is its words and one end.
"""

from __future__ import annotations

from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from broadloom.llm.common import slices, worker_state
from broadloom.session import durable

BASE = np.uint64(0x2545F4914F6CDD1D)
SLOT_BITS = 22
LONG = 96
WORDS_AT_ONCE = 20_000
COUNTED_AT_ONCE = 150_000
LN10 = float(np.log(10.0))


def read_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Surfaces and prior probabilities of a SentencePiece vocabulary.

    Scores of a unigram vocabulary are log-probabilities. Those of a merge vocabulary are negative ranks: they
    become a Zipf law. A byte piece and a character piece of one surface are one piece.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    surface, score = [], []
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            continue
        surface.append(bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode())
        score.append(sp.get_score(i))
    score = np.array(score)
    weight = 1 / (2 - score) if np.all(score == np.round(score)) else np.exp(score)
    total: dict[bytes, float] = {}
    for s, w in zip(surface, weight):
        total[s] = total.get(s, 0.0) + float(w)
    for b in range(256):
        total.setdefault(bytes([b]), float(weight.min()))
    weight = np.array(list(total.values()))
    return list(total), weight / weight.sum()


class Lattice:
    """Sums over all segmentations of words, many words of one length at a time."""

    def __init__(self, surfaces: list[bytes], logp: np.ndarray):
        self.longest = max(map(len, surfaces))
        self.hash = np.zeros(len(surfaces), np.uint64)
        for i, s in enumerate(surfaces):
            h = 0
            for b in s:
                h = (h * int(BASE) + b + 1) % (1 << 64)
            self.hash[i] = h
        if len(np.unique(self.hash)) < len(surfaces):
            raise ValueError("two pieces share a hash")
        shift = np.uint64(64 - SLOT_BITS)
        self.first, self.second = np.zeros(1 << SLOT_BITS, np.int32), {}
        taken = np.zeros(1 << SLOT_BITS, bool)
        for i, slot in enumerate((self.hash >> shift).tolist()):
            if taken[slot]:
                self.second[int(self.hash[i])] = i  # the few whose slot is taken
            else:
                taken[slot], self.first[slot] = True, i
        self.crowded = np.array(sorted(self.second), np.uint64)
        self.crowded_id = np.array([self.second[h] for h in self.crowded.tolist()], np.int32)
        self.logp = np.append(logp, -np.inf)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash; the last place of ``logp`` stands for none."""
        i = self.first[h >> np.uint64(64 - SLOT_BITS)]
        out = np.where(self.hash[i] == h, i, len(self.logp) - 1)
        if len(self.crowded):
            at = np.minimum(np.searchsorted(self.crowded, h), len(self.crowded) - 1)
            out = np.where(self.crowded[at] == h, self.crowded_id[at], out)
        return out

    def arcs(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each length, the piece from each start (rows: starts, columns: words)."""
        size = len(codes)
        h = np.zeros(codes.shape, np.uint64)
        out = []
        for k in range(min(self.longest, size)):
            h = h[:size - k] * BASE + codes[k:]
            out.append(self._find(h))
        return out

    def forward(self, arcs: list[np.ndarray], size: int, n: int) -> np.ndarray:
        a = np.zeros((size + 1, n))
        for e in range(1, size + 1):
            a[e] = np.logaddexp.reduce([a[e - k] + self.logp[arcs[k - 1][e - k]] for k in range(1, min(len(arcs), e) + 1)], axis=0)
        return a

    def backward(self, arcs: list[np.ndarray], size: int, n: int) -> np.ndarray:
        b = np.zeros((size + 1, n))
        for s in range(size - 1, -1, -1):
            b[s] = np.logaddexp.reduce([b[s + k] + self.logp[arcs[k - 1][s]] for k in range(1, min(len(arcs), size - s) + 1)], axis=0)
        return b

    @staticmethod
    def _groups(words: list[bytes]):
        """(positions, codes with one column per word) of the words of each length; very long ones by themselves."""
        sizes = np.array([len(w) for w in words])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            step = len(at) if size < LONG else max(1, 4_000_000 // int(size))
            for i in range(0, len(at), step):
                here = at[i:i + step]
                flat = np.frombuffer(b"".join(words[j] for j in here), np.uint8).reshape(len(here), size)
                codes = np.empty((size + 1, len(here)), np.uint64)
                codes[0] = 33  # the blank
                codes[1:] = flat.T
                codes[1:] += np.uint64(1)
                yield here, codes

    def log_likelihood(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros(len(words))
        for at, codes in self._groups(words):
            out[at] = self.forward(self.arcs(codes), *codes.shape)[-1]
        return out

    def expected(self, words: list[bytes], count: np.ndarray) -> np.ndarray:
        """Expected number of each piece in ``count`` copies of each word."""
        out = np.zeros(len(self.logp))
        for at, codes in self._groups(words):
            arcs, (size, n) = self.arcs(codes), codes.shape
            a, b, c = self.forward(arcs, size, n), self.backward(arcs, size, n), count[at]
            for k, piece in enumerate(arcs, 1):
                share = np.exp(a[:size - k + 1] + self.logp[piece] + b[k:] - a[-1]) * c
                out += np.bincount(piece.ravel(), share.ravel(), len(out))
        return out[:-1]


def words_of(text: bytes | None) -> list[bytes]:
    """Words between ASCII blanks, A-Z lower-cased."""
    return (text or b"").lower().split()


def _count(groups, batches):
    """Words of a task, added up by group; handed on whenever there are many."""
    seen: dict[bytes, list[int]] = {}

    def out():
        words, counts = list(seen), np.array(list(seen.values()), np.int64).reshape(-1, groups + 1)
        seen.clear()
        return pa.record_batch([pa.array(words, pa.binary()), *map(pa.array, counts.T)], names=["word", "n", *(f"c{k}" for k in range(groups))])

    for batch in slices(batches):
        for train, k, text in zip(*(batch.column(c).to_pylist() for c in ("train", "part", "text"))):
            for w in words_of(text):
                e = seen.get(w)
                if e is None:
                    e = seen[w] = [0] * (groups + 1)
                e[0] += 1
                if train:
                    e[k + 1] += 1
            if len(seen) > COUNTED_AT_ONCE:
                yield out()
    if seen:
        yield out()


def _many(batches):
    """The rows of a task, some tens of thousands at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= WORDS_AT_ONCE:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _lattice(sent, name: str, logp):
    model = worker_state("lattice:" + name, lambda: Lattice(sent.value, logp))
    model.logp = np.append(logp, -np.inf)
    return model


def _expect(sent, name, logp, batches):
    total = np.zeros(len(logp))
    for t in _many(batches):
        total += _lattice(sent, name, logp).expected(t.column("word").to_pylist(), np.ones(t.num_rows))
    used = np.flatnonzero(total)
    yield pa.record_batch([pa.array(used, pa.int32()), pa.array(total[used])], names=["piece", "n"])


def _weigh(sent, name, logp, batches):
    for t in _many(batches):
        z = _lattice(sent, name, logp).log_likelihood(t.column("word").to_pylist())
        yield from pa.table([*t.columns, pa.array(z / LN10)], names=[*t.column_names, "lattice"]).to_batches()


def _score(head, key, batches):
    """Frequent words are summed here; the others go along for the join."""
    words, c, base, by_group = head.value
    place = worker_state("frequent:" + key, lambda: {w: i for i, w in enumerate(words)})
    number = TaskContext.get().partitionId() << 33
    for batch in slices(batches):
        out = {k: [] for k in ("row", "n", "known", "base", "groups", "rare")}
        for text in batch.column("text").to_pylist():
            w = words_of(text)
            at = np.fromiter(map(place.get, w, repeat(-1)), np.int32, len(w))
            f = at[at >= 0]
            out["row"].append(number)
            out["n"].append(len(w))
            out["known"].append(int((c[f] > 0).sum()))
            out["base"].append(float(base[f].sum()))
            out["groups"].append(by_group[f].sum(0))
            out["rare"].append([w[i] for i in np.flatnonzero(at < 0).tolist()])
            number += 1
        kinds = dict(row=pa.int64(), n=pa.int64(), known=pa.int64(), base=pa.float64(), groups=pa.list_(pa.float64()), rare=pa.list_(pa.binary()))
        yield pa.record_batch([batch.column("doc_id"), batch.column("train"), *(pa.array(out[k], t) for k, t in kinds.items())],
                              names=["doc_id", "train", *kinds])


def score_documents(docs: DataFrame, train: Column, vocabulary: str, doc_id: str = "doc_id", text: str = "text", group: str | None = None,
                    rounds: int = 2, keep_prior: float = 1e-4, keep_all: float = 0.05, frequent: int = 100_000, most_groups: int = 8) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    ``train`` says which rows to learn from; ``group`` names a column of them to learn frequent words by, its most
    common values first, all beyond ``most_groups`` together, NULL being a value. The base is the add-0.1 unigram of
    whole words and ends; the score is the lattice model's. NULL and empty texts are the end alone. Repeated rows count
    and are scored as often as they come; a NULL doc_id stays NULL. Without training rows the pieces keep the
    vocabulary's own weights and all words come from them.

    Texts are read twice and not moved. Distinct words are counted in each task before the shuffle. The ``frequent``
    most frequent words (at most) travel to the tasks, the others are joined; in text these are a small part of the
    tokens, none of them frequent. The driver sees the pieces' weights and the frequent words only.
    """
    spark = docs.sparkSession
    value = F.col(group).cast("string") if group else F.lit(None).cast("string")
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), value.alias("value"),
                       F.col(text).cast("binary").alias("text"))
    # One row for each of the most common groups, then the number of training documents in all.
    common = base.filter("train").groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(most_groups - 1).collect()
    part = F.lit(len(common))
    for k, r in enumerate(common):
        part = F.when(F.col("value").eqNullSafe(F.lit(r["value"])), k).otherwise(part)
    base, groups = base.withColumn("part", part.cast("int")), len(common) + 1
    ends_of = [0] * groups
    for r in base.filter("train").groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect():
        ends_of[r["part"]] = r["n"]
    ends = sum(ends_of)
    names = [f"c{k}" for k in range(groups)]
    counted = base.select("train", "part", "text").mapInArrow(partial(_count, groups), "word binary, n bigint, " + ", ".join(f"{c} bigint" for c in names))
    words = durable(counted.groupBy("word").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).withColumn(
        "c", sum((F.col(c) for c in names), F.lit(0))))
    level = F.floor(F.log2("n") * 8).cast("int")
    # At most a few hundred classes of frequency.
    spread = words.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("c"), F.sum((F.col("c") == 1).cast("bigint")).alias("once"),
                                                 F.sum((F.col("c") > 0).cast("bigint")).alias("v")).toArrow().to_pylist()
    n_train, distinct = sum(r["c"] for r in spread) + ends, sum(r["v"] for r in spread) + (ends > 0)
    # The share of words seen once foretells that of new words.
    new = (sum(r["once"] for r in spread) + 1) / (n_train + 1) if n_train else 1.0

    surfaces, prior = read_pieces(vocabulary)
    sent, name, p = spark.sparkContext.broadcast(surfaces), vocabulary, prior
    for _ in range(rounds if n_train > ends else 0):
        got = words.filter("c > 0").select("word").mapInArrow(partial(_expect, sent, name, np.log(p)), "piece int, n double").groupBy("piece").agg(
            F.sum("n").alias("n")).toArrow()
        n = np.zeros(len(p))
        n[got.column("piece").to_numpy()] = got.column("n").to_numpy()
        p = (1 - keep_prior) * n / n.sum() + keep_prior * prior
    kept = ", ".join(f"{c} bigint" for c in names)
    weighed = durable(words.mapInArrow(partial(_weigh, sent, name, np.log(p)), f"word binary, n bigint, {kept}, c bigint, lattice double"))

    scale = float(np.log10(n_train + 0.1 * (distinct + 1)))
    total, least = 0, 10_000
    for r in sorted(spread, key=lambda r: -r["l"]):
        total += r["k"]
        if total > frequent:
            break
        least = r["l"]
    head = weighed.filter(level >= least).toArrow()
    c, lattice = head.column("c").to_numpy().astype(float), head.column("lattice").to_numpy()
    of = np.stack([head.column(k).to_numpy() for k in names], 1).astype(float).reshape(len(c), groups)
    # A group's shares of the frequent words and the end, together as heavy as in the whole corpus.
    all_ends = np.array(ends_of, float)
    mass = (c.sum() + ends) / max(n_train, 1)
    own = np.maximum(of.sum(0) + all_ends, 1) / max(mass, 1e-300)
    mixed = lambda mine, every: (1 - new) * ((1 - keep_all) * mine / own + keep_all * every / max(n_train, 1))
    with np.errstate(divide="ignore"):
        by_group = np.logaddexp(np.log(mixed(of, c[:, None])), (np.log(new) + lattice * LN10)[:, None]) / LN10
        end_log = np.log10(mixed(all_ends, float(ends))) if ends else np.zeros(groups)
        weight = np.log10(all_ends / ends) if ends else np.log10(np.ones(groups) / groups)
    sent_head = spark.sparkContext.broadcast((head.column("word").to_pylist(), c, np.log10(c + 0.1) - scale, by_group))
    parts = durable(base.select("doc_id", "train", "text").mapInArrow(
        partial(_score, sent_head, str(sent_head._jbroadcast.id()) + spark.sparkContext.applicationId),
        f"doc_id {docs.schema[doc_id].dataType.simpleString()}, train boolean, row bigint, n bigint, known bigint, base double, "
        "groups array<double>, rare array<binary>"))
    seen = F.col("c") > 0
    shared = F.log10(F.lit(float(1 - new)) * F.col("c") / max(n_train, 1) + F.lit(float(new)) * F.pow(F.lit(10.0), "lattice"))
    rare = parts.select("row", F.explode("rare").alias("word")).join(weighed.filter(level < least).select("word", "c", "lattice"), "word").select(
        "row", seen.cast("bigint").alias("known"), (F.log10(F.col("c") + 0.1) - scale).alias("base"),
        F.when(seen, shared).otherwise(F.col("lattice") + float(np.log10(new))).alias("rest"))
    sums = parts.drop("rare").withColumn("rest", F.lit(0.0)).unionByName(rare, allowMissingColumns=True).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("train").alias("train"), F.max("n").alias("n"), F.sum("known").alias("known"),
        F.sum("base").alias("base"), F.sum("rest").alias("rest"), F.max("groups").alias("groups"))
    # Marginal over the groups that training documents have, the largest term taken out.
    terms = F.array(*[F.col("groups")[k] + float(weight[k] + end_log[k]) for k in range(groups) if np.isfinite(weight[k] + end_log[k])])
    top = F.array_max(terms)
    score = F.col("rest") + top + F.log10(F.aggregate(terms, F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), x - top)))
    return sums.select("doc_id", (~F.col("train")).alias("held_out"), (F.col("n") + 1).alias("n_tokens"),
                       (F.col("known") + int(ends > 0)).alias("n_known"), F.lit(int(n_train)).cast("bigint").alias("train_tokens"),
                       (F.col("base") + float(np.log10(ends + 0.1) - scale)).alias("base_score"), score.alias("score"))
