"""Near-duplicate documents: MinHash candidates, exact links, connected components.

1. One pass over the texts gives each document's set of distinct five-word shingles as 64-bit hashes, its digest
   and the minima of 128 universal hashes of the set, in 32 bands of four. Two sets of similarity 0.75 share no
   band once in 190 000 times.
2. Documents with equal sets form a class; only one of each class goes on.
3. Members of a bucket (equal band) are paired with one member, its centre: linear in the bucket, whatever its
   size. Pairs pass bounds on size, then the estimate from the signatures, then the exact test on full sets.
   Some bands go first; the others pair only what those have not already connected.
4. Buckets that still hold several components are compared exhaustively: members outside the largest component,
   in blocks of bounded size, against all members in chunks of bounded size, by their signatures; what those leave
   is confirmed on full sets. Buckets of one largest component go together where that is no more comparisons than
   one by one: a document that shares many bands then travels once. Only links that connect something new come out.
   So no link is lost to the shortcut of step 3.
5. Components by alternating large-star and small-star, once over documents; links found later join components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from broadloom.llm.common import slices, worker_state
from broadloom.llm.components import connected_components
from broadloom.session import durable

HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS
FIRST_BANDS = 6
#: Signatures that agree in fewer places belong to pairs more than six standard deviations below similarity 0.75.
LEAST_AGREEMENT = 66
#: Documents of a block and of a chunk, and shingles of either.
BLOCK, CHUNK, BLOCK_SHINGLES = 2048, 4096, 1 << 19
WORDS_KEPT = 150_000
MULTIPLIERS = np.random.default_rng(20_240_517).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SEED_BY_LENGTH, STEP, SPREAD = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD)


class _WordHashes(dict):
    """64-bit hash of a word, remembered for frequent ones; forgets everything when full."""

    def __missing__(self, word):
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: bytes | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a UTF-8 text; a shorter text is one shingle, no words none."""
    words = (text or b"").lower().split()  # on bytes: A-Z only, and exactly the six ASCII blanks
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(worker_state("word_hashes", _WordHashes).__getitem__, words), np.uint64, len(words))
    k = min(size, len(words))
    n = len(w) - k + 1
    h = w[:n] + np.uint64(SEED_BY_LENGTH * k % (1 << 64))
    for j in range(1, k):
        h = h * STEP + w[j:j + n]
    h ^= h >> np.uint64(33)
    h *= SPREAD
    h ^= h >> np.uint64(29)
    return np.unique(h)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Upper 32 bits of the minimum of each universal (multiply-shift) hash."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 512):
        np.minimum(low, (MULTIPLIERS[:, None] * shingles[None, i:i + 512]).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band of a signature."""
    h = np.zeros(BANDS, np.uint64)
    for part in sig.view(np.uint32).astype(np.uint64).reshape(BANDS, ROWS).T:
        h = (h ^ part) * SPREAD + STEP
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), "<i8").tolist())


def _profiles(batches):
    for batch in slices(batches):
        out = {"n": [], "d1": [], "d2": [], "keys": []}
        for text in batch.column("text").to_pylist():
            s = shingle_set(text)
            d = _digest(s) if len(s) else (None, None)
            out["n"].append(len(s))
            out["d1"].append(d[0])
            out["d2"].append(d[1])
            out["keys"].append(band_keys(signature(s)) if len(s) else None)
        yield pa.record_batch([batch.column("id"), pa.array(out["n"], pa.int64()), pa.array(out["d1"], pa.int64()),
                               pa.array(out["d2"], pa.int64()), pa.array(out["keys"], pa.list_(pa.int64()))],
                              names=["id", "n", "d1", "d2", "keys"])


def _sets(batches):
    for batch in slices(batches):
        sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
        marks = [_digest(s) for s in sets]
        yield pa.record_batch([batch.column("id"), pa.array([m[0] for m in marks], pa.int64()), pa.array(
            [m[1] for m in marks], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(
            [signature(s) if len(s) else None for s in sets], pa.list_(pa.int32()))], names=["id", "d1", "d2", "shingles", "sig"])


def _block_links(percent: int):
    """Links between the block (side 0) and the chunk (side 1) of a group that join different components."""
    def compare(pdf):
        left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
        found_u, found_v, comp = [], [], {}

        def root(x):
            while comp.setdefault(x, x) != x:
                comp[x] = comp[comp[x]]
                x = comp[x]
            return x

        if len(left) and len(right):
            sig_l, sig_r = np.stack(left.sig.to_list()), np.ascontiguousarray(np.stack(right.sig.to_list()).T)
            sets_l, sets_r = left.shingles.to_list(), right.shingles.to_list()
            ids_l, ids_r, c_l, c_r = (x.to_numpy() for x in (left.id, right.id, left.component, right.component))
            n_l, n_r = (np.array([len(x) for x in sets]) for sets in (sets_l, sets_r))
            for i in range(len(sets_l)):
                near = np.flatnonzero((c_r != c_l[i]) & (100 * np.minimum(n_l[i], n_r) >= percent * np.maximum(n_l[i], n_r)))
                alike = np.zeros(len(near), np.int16)
                for h in range(HASHES):
                    alike += sig_r[h, near] == sig_l[i, h]
                near = near[alike >= LEAST_AGREEMENT]
                for j in near.tolist():
                    a, b = root(int(c_l[i])), root(int(c_r[j]))
                    if a != b:
                        common = len(np.intersect1d(sets_l[i], sets_r[j], assume_unique=True))
                        if 100 * common >= percent * (n_l[i] + n_r[j] - common):
                            comp[a] = b
                            found_u.append(ids_l[i])
                            found_v.append(ids_r[j])
        return pdf.__class__({"u": np.array(found_u, np.int64), "v": np.array(found_v, np.int64)})
    return compare


def _pairs(buckets: DataFrame, of: Column, percent: int) -> DataFrame:
    """Each member with its bucket's centre, the member of smallest hash; sizes must allow a link."""
    buckets = buckets.select("band", "key", "id", "n", *(["component"] if "component" in buckets.columns else []))
    chosen = buckets.filter(of)
    centre = chosen.groupBy("band", "key").agg(F.min(F.struct(F.xxhash64("id").alias("h"), *[
        c for c in chosen.columns if c not in ("band", "key")])).alias("c"))
    pairs = chosen.join(centre, ["band", "key"]).filter("id <> c.id").filter(
        f"100 * least(n, c.n) >= {percent} * greatest(n, c.n)")
    if "component" in chosen.columns:
        pairs = pairs.filter("component <> c.component")
    return pairs.select(F.col("id").alias("u"), F.col("c.id").alias("v")).distinct()


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    u = sets.select(F.col("id").alias("u"), F.col("shingles").alias("set_u"), F.col("sig").alias("sig_u"))
    v = sets.select(F.col("id").alias("v"), F.col("shingles").alias("set_v"), F.col("sig").alias("sig_v"))
    alike = F.size(F.filter(F.zip_with("sig_u", "sig_v", lambda a, b: a == b), lambda same: same))
    shared = F.size(F.array_intersect("set_u", "set_v"))
    return pairs.join(u, "u").join(v, "v").filter(alike >= LEAST_AGREEMENT).filter(
        100 * shared >= percent * (F.size("set_u") + F.size("set_v") - shared)).select("u", "v")


def _labelled(buckets: DataFrame, parts: DataFrame) -> DataFrame:
    return buckets.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))


def _joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """``parts`` (node, component) after more links: only components, as nodes of a small graph, are joined."""
    u, v = (parts.select(F.col("node").alias(x), F.col("component").alias("c" + x)) for x in "uv")
    met = links.join(u, "u", "left").join(v, "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    into = durable(connected_components(met).select("node", F.col("component").alias("into")))
    moved = parts.join(into.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    return durable(moved.union(into.join(parts.select("node"), "node", "left_anti").select("node", F.col("into").alias("component"))))


def group_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``.

    Words are runs of anything but ASCII blanks, A-Z lower-cased; a text with fewer than five words is one shingle.
    Documents whose sets meet 100 * intersection >= ``percent`` * union are linked; ``percent`` below about 70
    would need more bands. component_id is the smallest id reachable. Texts without words, NULL texts and rows with
    a NULL id are linked with nothing: their component is their own id, and a row with a NULL id is kept. Rows that
    repeat an id share one result; should their texts differ, the one of smallest digest counts. Integer ids only.

    The texts are read twice and moved once, only those that share a bucket; what is kept per document until the
    end is 300 bytes, and as much again of each class. Everything reused is written to the shared folder.
    """
    base = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("binary").alias("text"))
    profiles = durable(base.mapInArrow(_profiles, "id bigint, n bigint, d1 bigint, d2 bigint, keys array<bigint>"))
    real = profiles.filter("n > 0 and id is not null")
    one_text = real.groupBy("id").agg(F.min(F.struct("d1", "d2")).alias("d")).select("id", "d.d1", "d.d2")
    first = one_text.groupBy("d1", "d2").agg(F.min("id").alias("rep"))
    classes = durable(first.join(real.withColumnRenamed("id", "rep"), ["rep", "d1", "d2"]).dropDuplicates(
        ["rep", "d1", "d2"]))  # by the join's columns, so that the rows move once; each rep has one digest
    copies = one_text.join(first, ["d1", "d2"]).filter("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))

    rows = classes.select(F.col("rep").alias("id"), "n", F.posexplode("keys").alias("band", "key")).select("band", "key", "id", "n")
    several = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    buckets = durable(rows.join(several, ["band", "key"]))

    wanted = buckets.select("id").distinct()
    texts = base.join(durable(wanted), "id", "left_semi")
    source = classes.select(F.col("rep").alias("id"), "d1", "d2")
    sets = durable(texts.mapInArrow(_sets, "id bigint, d1 bigint, d2 bigint, shingles array<bigint>, sig array<int>").join(
        source, ["id", "d1", "d2"]).dropDuplicates(["id", "d1", "d2"]).select("id", "shingles", "sig"))

    parts = durable(connected_components(durable(_confirm(_pairs(buckets, F.col("band") < FIRST_BANDS, percent), sets, percent))))
    more = _confirm(_pairs(durable(_labelled(buckets, parts)), F.lit(True), percent), sets, percent)
    parts = _joined(parts, durable(more))
    parts = _joined(parts, durable(_rest(durable(_labelled(buckets, parts)), sets, percent)))

    # A class's smallest id speaks for its copies; parts know only those.
    spoken = copies.join(parts, F.col("v") == F.col("node"), "left").select(F.col("u").alias("node"), F.coalesce("component", "v").alias("component"))
    out = profiles.select("id", "n", "d1", "d2").join(parts.union(spoken), F.col("id") == F.col("node"), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").cast(docs.schema[doc_id].dataType).alias("doc_id"), F.col("n").alias("n_shingles"),
                      component.cast(docs.schema[doc_id].dataType).alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _rest(labelled: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components that still meet in a bucket, found by comparing everything there."""
    per = labelled.groupBy("band", "key", "component").agg(F.count(F.lit(1)).alias("c"))
    open_ = per.groupBy("band", "key").agg(F.count(F.lit(1)).alias("parts"), F.sum("c").alias("m"), F.max(
        F.struct("c", "component")).alias("top")).filter("parts > 1 and m > 2").select("band", "key", F.col("top.component").alias("top"))
    members = durable(labelled.join(open_, ["band", "key"]).select(
        "band", "key", "id", "n", "component", "top", (F.col("component") != F.col("top")).cast("long").alias("out")))
    # Either way compares all that meet in a bucket; the cheaper one is taken.
    apart = members.groupBy("band", "key", "top").agg((F.sum("out") * F.count(F.lit(1))).cast("double").alias("c")).groupBy("top").agg(
        F.sum("c").alias("apart"))
    once = members.groupBy("top", "id").agg(F.max("n").alias("n"), F.max("component").alias("component"), F.max("out").alias("out"))
    whole = once.groupBy("top").agg((F.sum("out") * F.count(F.lit(1))).cast("double").alias("whole")).join(apart, "top").filter(
        "whole <= apart").select("top")
    whole = durable(whole)
    cols = ["band", "key", "id", "n", "component", "top"]
    together = once.join(whole, "top", "left_semi").select(F.lit(-1).alias("band"), F.col("top").alias("key"), *cols[2:])
    members = members.join(whole, "top", "left_anti").select(*cols)
    # The same members may share many bands: one bucket of each kind is enough.
    print_ = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(
        F.xxhash64("id", F.lit(1))).alias("y"))
    one = print_.groupBy("m", "x", "y").agg(F.min(F.struct("band", "key")).alias("b")).select("b.band", "b.key")
    members = durable(members.join(one, ["band", "key"], "left_semi").select(*cols).union(together))

    blocks = lambda share: F.greatest(F.lit(1), F.ceil(F.col(share)))
    left = F.col("component") != F.col("top")
    sizes = members.groupBy("band", "key").agg(
        F.greatest(F.sum(left.cast("int")) / BLOCK, F.sum(F.when(left, F.col("n"))) / BLOCK_SHINGLES).alias("left"),
        F.greatest(F.count(F.lit(1)) / CHUNK, F.sum("n") / BLOCK_SHINGLES).alias("right"))
    sizes = sizes.select("band", "key", blocks("left").cast("int").alias("l"), blocks("right").cast("int").alias("r"))
    m = members.join(sizes, ["band", "key"]).withColumn("h", F.xxhash64("id", "band"))
    side0 = m.filter("component <> top").withColumn("i", F.pmod("h", "l")).withColumn("j", F.explode(F.expr("sequence(0, r - 1)")))
    side1 = m.withColumn("j", F.pmod("h", "r")).withColumn("i", F.explode(F.expr("sequence(0, l - 1)")))
    cols = ["band", "key", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "id", "component"]
    both = side0.select(*cols, F.lit(0).alias("side")).union(side1.select(*cols, F.lit(1).alias("side")))
    return both.join(sets, "id").groupBy("band", "key", "i", "j").applyInPandas(
        _block_links(percent), "u bigint, v bigint")
