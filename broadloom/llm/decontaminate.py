"""Benchmark decontamination: which documents hold passages of benchmark items.

An exact set join with prefix filtering. Every window of 13 consecutive item words (a shorter item is one
window) must lie in the document whole, so one of its words is a sufficient prefix: the rarest in the corpus
(shingles of one word; longer ones cost an interpreted function call per document word). Document words meet
only those; a match fixes the window's place, bounds on length and position discard impossible places, and the
words of the place are compared with the window. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from broadloom.llm.common import ascii_lower
from broadloom.operators.lookup import settle
from broadloom.session import durable

#: Everything that is not a letter or digit of ASCII or beyond ASCII; splitting there is several times as fast as
#: matching the words.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ADDED = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def _split(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(text, GAP), ""), F.array().cast("array<string>"))


def words_of(text: Column) -> Column:
    """Words with A-Z lower-cased (ASCII letters, digits and everything beyond ASCII); empty for NULL."""
    return _split(ascii_lower(text))


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = 13) -> DataFrame:
    """(win array of words, items): the distinct windows, each with the sorted ids of its items as strings."""
    w = items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("words")).filter(
        F.size("words") > 0)
    length = F.least(F.lit(window), F.size("words"))
    at = F.explode(F.sequence(F.lit(1), F.size("words") - length + 1))
    return w.withColumn("at", at).select("item", F.slice("words", F.col("at"), length).alias("win")).groupBy("win").agg(
        F.array_sort(F.collect_set("item")).alias("items"))


def mark_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                      item_id: str = "item_id", item_text: str = "text", window: int = 13, share: int = 20,
                      max_windows: int = 200_000, max_bytes: int = 32 << 20) -> DataFrame:
    """``docs`` plus n_words, n_hit (words inside an occurrence of a window), n_items, items_sha256 and
    contaminated (some hit, and at least one word in ``share`` hit).

    NULL and wordless texts have no words and are clean; NULL item ids name no item but their windows still hit.
    Repeated rows and repeated ids are judged row by row. Columns that bear an added name are replaced. An empty
    table of items leaves all clean.

    Texts are read three times and never shuffled while the windows stay within ``max_windows`` and ``max_bytes``
    (checked on the data): then they are broadcast and candidates are verified where the text lies. A larger
    table of items joins by word, and only documents with a candidate are joined again for verification.
    """
    spark = docs.sparkSession
    found = item_windows(items, item_id, item_text, window)
    keep = [c for c in docs.columns if c not in ADDED]
    key = [F.col(doc_id).alias("k_id"), F.xxhash64(text).alias("k_text")]
    counted = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), *key, F.size(_split(F.col(text))).cast("bigint").alias("n_words"))
    tokens = docs.select(*key, words_of(F.col(text)).alias("words"))

    # Rarity of the items' words over the whole corpus, added up inside each task first.
    parts = found.select("win", "items", F.posexplode("win").alias("off", "s"))
    vocabulary, small = settle(parts.select("s").distinct(), max_windows, max_bytes)
    vocabulary = F.broadcast(vocabulary) if small else vocabulary
    rarity = tokens.select(F.explode("words").alias("s")).join(vocabulary, "s", "left_semi").groupBy("s").agg(
        F.count(F.lit(1)).alias("df"))
    # A word that no document has rules its window out at once.
    prefix = parts.join(rarity, "s", "left").groupBy("win", "items").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "off", "s")).alias("rare")).filter("rare.df > 0").select(
        F.col("rare.s").alias("s"), F.col("rare.off").alias("off"), "win", "items")
    prefix, small = settle(prefix, max_windows, max_bytes)

    start = F.col("pos") - F.col("off")
    fits = (start >= 0) & (start + F.size("win") <= F.size("words"))
    same = F.slice("words", start + 1, F.size("win")) == F.col("win")
    if small:
        hits = tokens.select("k_id", "k_text", "words", F.posexplode("words").alias("pos", "s")).join(
            F.broadcast(prefix), "s").filter(fits).filter(same).select("k_id", "k_text", "items", start.alias("start"),
                                                                       F.size("win").alias("n"))
    else:
        places = tokens.select("k_id", "k_text", F.size("words").alias("m"), F.posexplode("words").alias("pos", "s")).join(
            prefix, "s").filter((start >= 0) & (start + F.size("win") <= F.col("m"))).select(
            "k_id", "k_text", "items", start.alias("start"), "win").distinct()
        grouped = places.groupBy("k_id", "k_text").agg(F.collect_list(F.struct("items", "start", "win")).alias("c"))
        t = tokens.select("k_id", "k_text", "words").alias("t")
        hits = grouped.alias("g").join(t, F.expr("g.k_id <=> t.k_id and g.k_text = t.k_text")).select(
            "g.k_id", "g.k_text", F.explode(F.filter("c", lambda c: F.slice(F.col("words"), c["start"] + 1, F.size(c["win"]))
                                                     == c["win"])).alias("c")).select(
            "k_id", "k_text", "c.items", "c.start", F.size("c.win").alias("n"))
    spans = F.collect_set(F.struct("start", "n"))
    covered = F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1)))
    hits = hits.groupBy("k_id", "k_text").agg(F.size(F.array_distinct(covered)).cast("bigint").alias("n_hit"),
                                              F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    # Few rows as a rule; written, so that Spark knows and need not move the documents to join them.
    return _judge(counted, durable(hits), keep, share)


def _judge(counted: DataFrame, hits: DataFrame, keep: list[str], share: int) -> DataFrame:
    hits = hits.select(F.col("k_id").alias("h_id"), F.col("k_text").alias("h_text"), "n_hit", F.col("items").alias("h_items"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    ids = F.coalesce("h_items", F.array().cast("array<string>"))
    return counted.join(hits, F.col("k_id").eqNullSafe(F.col("h_id")) & (F.col("k_text") == F.col("h_text")), "left").select(
        *[F.col(f"row.`{c}`") for c in keep], "n_words", n_hit.alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(ids)), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"))
