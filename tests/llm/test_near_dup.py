import random

import brute

from broadloom.llm import near_dup

SCHEMA = "doc_id bigint, text string, rep string, component string"


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in near_dup.group_near_duplicates(df).collect()), key=repr)


def check(spark, rows):
    want = brute.near_dup(rows)
    assert run(spark, rows) == sorted((want[i] for i, _ in rows), key=repr)


def words(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def test_chains_copies_and_pairs_around_the_threshold(spark):
    rng, rows = random.Random(1), []
    for _ in range(12):
        base = words(rng, rng.randrange(30, 160))
        for _ in range(rng.randrange(2, 9)):  # a chain: each edit starts from the last
            rows.append((rng.randrange(10 ** 9), " ".join(base)))
            for _ in range(rng.randrange(0, 5)):
                base = list(base)
                base[rng.randrange(len(base))] = f"z{rng.randrange(10 ** 6)}"
    rows += [(5, "a b"), (6, "A\tb"), (7, "a b c"), (8, ""), (9, None), (10, " \n "), (11, "É x y z q"), (12, "é x y z q")]
    check(spark, list(dict(rows).items()))


def test_large_bucket_with_members_that_fail_its_centre(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    monkeypatch.setattr(near_dup, "CHUNK", 5)
    rng, base, rows = random.Random(2), words(random.Random(3), 120), []
    for i in range(60):
        doc = list(base)
        for _ in range(rng.choice([2, 3, 4, 5, 6, 7])):
            doc[rng.randrange(120)] = f"q{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(doc)))
    check(spark, rows)


def test_repeated_rows_null_ids_and_empty_table(spark):
    assert run(spark, []) == []
    got = run(spark, [(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (None, None)])
    assert got == sorted([(3, 2, 1, False), (3, 2, 1, False), (None, 2, None, True), (1, 2, 1, True), (None, 0, None, True)], key=repr)


def test_signatures_stay_with_the_sets(spark, monkeypatch):
    """Tables that hold every document have its bands' hashes, not its signature, and the sets of few documents have theirs."""
    written, durable = [], near_dup.durable
    monkeypatch.setattr(near_dup, "durable", lambda df: written.append(durable(df)) or written[-1])
    rng = random.Random(4)
    rows = [(i, " ".join(words(rng, 40))) for i in range(60)] + [(100, "a b c d e f g h"), (101, "a b c d e f g h"), (102, "a b c d e f g h i")]
    check(spark, rows)
    assert [w.count() for w in written if "sig" in w.columns] == [2]
    assert [len(r["keys"]) for r in written[0].collect()] == [near_dup.BANDS] * len(rows)
