"""Lexical retrieval packing: documents that share words are laid into the same training sequence.

Documents are cut into whole windows, which are sequences of their own, and a tail. In how many documents each term
stands is counted over the whole corpus. Tails go to shards of about a thousand, sorted by the two terms of greatest
tf-idf in their documents, so that a shard holds tails on the same matter and copies lie together. Each shard is an
inverted index over the terms of its whole documents, with BM25 by the corpus's counts: a seed's unused neighbours, best
first, fill its window; the last one is cut to fit, and what is left of it stays in the index. So only the last sequence
of a shard is not full.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from broadloom.llm.bpe import Encoder
from broadloom.llm.common import slices, worker_state
from broadloom.session import durable

K1, B = 1.2, 0.75
TERMS = 1 << 16
STRIDE = 0x9E3779B97F4A7C15
PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _terms(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and their counts."""
    s = np.sort(ids, kind="stable")  # a radix sort for 16-bit numbers
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    return s[first], np.diff(np.append(first, len(s)))


def _idf(df: np.ndarray, n: int) -> np.ndarray:
    return np.log1p((n - df + 0.5) / (df + 0.5))


def _leading_terms(term: np.ndarray, n: np.ndarray, start: np.ndarray, df: np.ndarray, idf: np.ndarray) -> list[np.ndarray]:
    """The two ids of greatest tf-idf of each document, tf by its logarithm, among those that other documents have too.

    Documents begin at ``start`` and have an id at least; ties go to the smaller id; -1 where there is none.
    """
    weight = np.where(df[term] > 1, (1 + np.log(n)) * idf[term], -1.0)
    sizes, out = np.diff(start, append=len(term)), []
    for _ in range(2):
        best = np.maximum.reduceat(weight, start)
        first = np.minimum.reduceat(np.where(weight == np.repeat(best, sizes), np.arange(len(term)), len(term)), start)
        out.append(np.where(best >= 0, term[first].astype(np.int32), -1))
        weight[first] = -1.0
    return out


def _sketch(ids: np.ndarray) -> int:
    """Minimum hash of three consecutive ids: equal for most near copies."""
    w = ids.astype(np.uint64)
    w = np.concatenate((w, np.zeros(max(0, 3 - len(w)), np.uint64)))
    h = ((w[:-2] << np.uint64(32)) | (w[1:-1] << np.uint64(16)) | w[2:]) * np.uint64(STRIDE)
    return int((h ^ (h >> np.uint64(29))).min() >> np.uint64(1))


def _texts(batches, rows: int = 8192, size: int = 8 << 20):
    """(ids, texts) of up to ``rows`` rows and, beyond the first, ``size`` bytes."""
    ids, texts, held = [], [], 0
    for batch in slices(batches):
        for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            if texts and (len(texts) == rows or held + len(text or b"") > size):
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(i)
            texts.append(text)
            held += len(text or b"")
    if texts:
        yield ids, texts


def _encode(path: str, end: int, window: int, with_ids: bool, batches):
    encoder = worker_state("bpe:" + path, lambda: Encoder(path))
    for doc_ids, texts in _texts(batches):
        every, stop = encoder.encode(texts, end)
        out = {"total": [], "crcs": [], "ids": [], "terms": [], "counts": [], "sketch": [], "whole": []}
        for ids in np.split(every, stop[:-1]):
            whole = len(ids) // window * window
            out["total"].append(len(ids))
            out["crcs"].append([crc_of(ids[i:i + window]) for i in range(0, whole, window)])
            out["ids"].append(ids[whole:].tobytes())
            out["whole"].append(ids[:whole].tobytes() if with_ids else None)
            term, n = _terms(ids)
            out["terms"].append(term.tobytes())
            out["counts"].append(n.astype("<u4").tobytes())
            out["sketch"].append(_sketch(ids))
        columns = [pa.array(doc_ids, pa.int64()), pa.array(out["total"], pa.int64()), pa.array(out["crcs"], pa.list_(pa.int64())),
                   pa.array(out["ids"], pa.binary()), pa.array(out["terms"], pa.binary()), pa.array(out["counts"], pa.binary()),
                   pa.array(out["sketch"], pa.int64())]
        if with_ids:
            columns.append(pa.array(out["whole"], pa.binary()))
        yield pa.record_batch(columns, names=["doc_id", "total", "crcs", "ids", "terms", "counts", "sketch", "whole"][:len(columns)])


def _count_terms(batches):
    """(term, documents) of a task's documents; under -1 the documents, under -2 their ids."""
    df, docs, total = np.zeros(TERMS, np.int64), 0, 0
    for batch in slices(batches):
        for terms in batch.column("terms").to_pylist():
            df[np.frombuffer(terms, "<u2")] += 1
        docs += batch.num_rows
        total += sum(batch.column("total").to_pylist())
    term = np.flatnonzero(df)
    yield pa.record_batch([pa.array([*term.tolist(), -1, -2], pa.int32()), pa.array([*df[term].tolist(), docs, total], pa.int64())], names=["term", "n"])


def _lead(sent, batches):
    df, idf, _ = sent.value
    for batch in slices(batches):
        terms = batch.column("terms").to_pylist()
        start = np.cumsum([0, *(len(t) // 2 for t in terms[:-1])])
        lead = _leading_terms(np.frombuffer(b"".join(terms), "<u2"), np.frombuffer(b"".join(batch.column("counts").to_pylist()), "<u4"), start, df, idf)
        yield pa.record_batch([*batch.columns, *(pa.array(x, pa.int32()) for x in lead)], names=[*batch.schema.names, "term", "next"])


@dataclass
class Corpus:
    """The terms of the tails' whole documents, and what the corpus says of terms and lengths."""
    terms: list[np.ndarray]
    counts: list[np.ndarray]
    lengths: np.ndarray
    idf: np.ndarray
    mean: float


class Index:
    """BM25 postings of a shard's tails, in one array sorted by term; terms of a single tail find nothing and are left out.

    With a corpus, the terms are those of the whole documents, weighed by its counts; else the tails are all there is.
    """

    def __init__(self, tails: list[np.ndarray], corpus: Corpus | None = None):
        self.n = len(tails)
        if corpus:
            lengths, mean = np.maximum(corpus.lengths, 1), corpus.mean
            key = np.concatenate([t.astype(np.int64) * self.n + i for i, t in enumerate(corpus.terms)])
            order = np.argsort(key)
            key, tf = key[order], np.concatenate(corpus.counts)[order].astype(np.int64)
        else:
            lengths = np.array([max(1, len(t)) for t in tails], float)
            mean = lengths.mean()
            key, tf = np.unique(np.concatenate([t.astype(np.int64) * self.n + i for i, t in enumerate(tails)]), return_counts=True)
        term, doc = np.divmod(key, self.n)
        self.terms, first, df = np.unique(term, return_index=True, return_counts=True)
        idf = corpus.idf[self.terms] if corpus else _idf(df, self.n)
        self.doc = doc
        self.weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / mean))
        self.first, self.df = first, np.where(df > 1, df, 0)
        order = np.argsort(doc, kind="stable")
        self.of_doc = np.split(np.repeat(np.arange(len(df)), df)[order], np.cumsum(np.bincount(doc, minlength=self.n))[:-1])

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every tail for the distinct terms of the seed."""
        t = self.of_doc[seed]
        n = self.df[t]
        at = np.arange(n.sum()) + np.repeat(self.first[t] - np.cumsum(n) + n, n)
        return np.bincount(self.doc[at], self.weight[at], self.n)

    def keep(self, tails: np.ndarray) -> None:
        """Only postings of these tails (a mask) stay: scores of the others are 0 from now on."""
        stays = tails[self.doc]
        before = np.concatenate(([0], np.cumsum(stays)))
        after = np.append(self.first[1:], len(stays))
        n = before[after] - before[self.first]
        self.first, self.df = before[self.first], np.where(n > 0, n, 0)
        self.doc, self.weight = self.doc[stays], self.weight[stays]


def fill_windows(tails: list[np.ndarray], window: int, corpus: Corpus | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of (tail, start in the tail, length): each tail's ids exactly once, all sequences full but the last."""
    left = np.array([len(t) for t in tails], np.int64)
    done = np.zeros(len(tails), np.int64)
    out = []
    if not left.sum():
        return out
    index = Index(tails, corpus)
    indexed = len(tails)
    for seed in np.argsort(-left, kind="stable").tolist():
        while left[seed]:
            take = int(min(left[seed], window))
            sequence, room = [(seed, int(done[seed]), take)], window - take
            done[seed] += take
            left[seed] -= take
            if room and left.any():
                order = np.flatnonzero(left)
                if 4 * len(order) < 3 * indexed:  # postings of used tails go
                    index.keep(left > 0)
                    indexed = len(order)
                order = order[np.argsort(-index.scores(seed)[order], kind="stable")]
                while room and len(order):
                    fits = np.flatnonzero(left[order] <= room)
                    at = fits[0] if len(fits) else 0
                    k = int(order[at])
                    take = int(min(left[k], room))
                    sequence.append((k, int(done[k]), take))
                    done[k] += take
                    left[k] -= take
                    room -= take
                    order = np.delete(order, at) if not left[k] else order
            out.append(sequence)
    return out


def _pieces(rows: list[tuple], with_ids: bool):
    """Record batches of pieces; the last item of a row is its ids."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    for i in range(0, len(rows), 1024):
        *columns, ids = zip(*rows[i:i + 1024])
        columns = [pa.array(c, pa.int64()) for c in columns]
        if with_ids:
            ends = np.cumsum([0, *map(len, ids)])
            columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32))))
        yield pa.record_batch(columns, names=names + ["ids"] * with_ids)


def _windows(window: int, batches):
    """Whole windows with their ids, where they lie. Their sequences have a number of 2^31 or more in the partition."""
    number = (TaskContext.get().partitionId() << 32) + (1 << 31)
    for batch in slices(batches):
        rows = []
        for doc, total, known, whole in zip(*(batch.column(c).to_pylist() for c in ["doc_id", "total", "crcs", "whole"])):
            ids = np.frombuffer(whole, "<u2")
            for i, crc in enumerate(known):
                rows.append((doc, i * window, window, crc, total, number, 0, ids[i * window:(i + 1) * window]))
                number += 1
        yield from _pieces(rows, True)


def _pack(window: int, with_ids: bool, sent, batches):
    """One shard: the rows of one partition, about ``shard_docs`` of them, with a tail each. ``with_ids``, the whole windows
    are not given here: their ids stay behind."""
    number = TaskContext.get().partitionId() << 32
    held = list(batches)
    if not sum(b.num_rows for b in held):
        return
    held = pa.Table.from_batches(held)
    doc_ids, totals, crcs, packed, terms, counts = (held.column(c).to_pylist() for c in ["doc_id", "total", "crcs", "ids", "terms", "counts"])
    rows, tails, wholes = [], [], []
    for doc, total, known, ids in zip(doc_ids, totals, crcs, packed):
        tails.append(np.frombuffer(ids, "<u2"))
        wholes.append(len(known) * window)
        for i, crc in enumerate(known if not with_ids else ()):
            rows.append((doc, i * window, window, crc, total, number, 0, ()))
            number += 1
    _, idf, mean = sent.value
    corpus = Corpus([np.frombuffer(t, "<u2") for t in terms], [np.frombuffer(n, "<u4") for n in counts], np.array(totals, float), idf, mean)
    for sequence in fill_windows(tails, window, corpus):
        offset = 0
        for k, start, length in sequence:
            ids = tails[k][start:start + length]
            rows.append((doc_ids[k], wholes[k] + start, length, crc_of(ids), totals[k], number, offset, ids))
            offset += length
        number += 1
    yield from _pieces(rows, with_ids)


def pack_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", window: int = 1024, end: int = 0,
                   shard_docs: int = 1024, with_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of sequences of ``window`` ids.

    A document is its ids and ``end``; NULL and empty texts are ``end`` alone. Every id lies in exactly one piece.
    Repeated rows are packed each on its own, a NULL doc_id stays NULL, an empty table gives no pieces. sequence_id is
    unique, with gaps; offsets in a sequence run on from 0. ``tokenizer`` is the path of a byte-level BPE file with ids
    below 65536, present on every executor.

    Texts are read once and not moved; what is shuffled is two bytes for each id of a tail and six for each distinct id
    of a document; the ids of whole windows stay where they were read. Shards are ranges of (leading term, second term, sketch, doc_id), so a very common term or a large
    group of copies spreads over several; a seed fills its window from its own shard.
    """
    base = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    kinds = "doc_id bigint, total bigint, crcs array<bigint>, ids binary, terms binary, counts binary, sketch bigint"
    both = durable(base.mapInArrow(partial(_encode, tokenizer, end, window, with_ids), kinds + ", whole binary" * with_ids))
    encoded = both.drop("whole")
    found = encoded.select("terms", "total").mapInArrow(_count_terms, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    n = {r["term"]: r["n"] for r in found}  # at most TERMS rows
    count, total, df = n.pop(-1, 0), n.pop(-2, 0), np.zeros(TERMS, np.int64)
    df[list(n)] = list(n.values())
    sent = docs.sparkSession.sparkContext.broadcast((df, _idf(df, count), total / max(1, count)))
    shards = max(1, -(-count // shard_docs))
    kinds_out = PIECE + ", ids array<int>" * with_ids
    packed = encoded.mapInArrow(partial(_lead, sent), kinds + ", term int, next int").repartitionByRange(
        shards, "term", "next", "sketch", "doc_id").mapInArrow(partial(_pack, window, with_ids, sent), kinds_out)
    if not with_ids:
        return packed
    return packed.union(both.filter("size(crcs) > 0").select("doc_id", "total", "crcs", "whole").mapInArrow(partial(_windows, window), kinds_out))
