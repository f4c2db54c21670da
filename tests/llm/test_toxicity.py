import random

import numpy as np
from pyspark.sql import functions as F

from broadloom.llm import toxicity

SCHEMA = "doc_id bigint, text string, toxicity string"


def made(rng, n):
    """Toxic: an insult together with a group's name; either alone is not."""
    rows, labels = [], []
    for i in range(n):
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(5, 60))]
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w += ["Insult!"] * a + ["group"] * b
        rng.shuffle(w)
        rows.append((i, " ".join(w), "x"))
        labels.append((i, int(a and b)))
    return rows, labels


def test_learns_pairs_and_keeps_every_row(spark):
    rows, labels = made(random.Random(1), 2500)
    extra = [(None, None, None), (-1, "", "y"), (-2, "w1 " * 50000, "z"), (0, rows[0][1], "again")]
    docs = spark.createDataFrame(rows + extra, SCHEMA)
    known = spark.createDataFrame(labels + [(None, 1), (1, None), (10 ** 9, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(docs, known, F.col("doc_id") % 4 != 2)
    out = toxicity.score_toxicity(docs, model)
    assert out.columns == ["doc_id", "text", "toxicity"]
    got = out.select("doc_id", F.col("toxicity").alias("s")).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.s <= 1 for r in got)
    label = dict(labels)
    held = [(r.s, label[r.doc_id]) for r in got if r.doc_id is not None and r.doc_id >= 0 and r.doc_id % 4 == 2]
    right = np.mean([(s >= 0.5) == bool(y) for s, y in held])
    assert right > 0.97


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "x")], SCHEMA)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(docs, none)
    assert 0 <= toxicity.score_toxicity(docs, model).first()["toxicity"] < 0.3
    assert toxicity.score_toxicity(docs.limit(0), model).collect() == []
    one = spark.createDataFrame([(1, 0)], none.schema)
    assert toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, one)).count() == 1


def test_sample_bounds_hold(spark):
    rows, labels = made(random.Random(2), 300)
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    assert toxicity.fit_toxicity(docs, known, max_docs=50).learnt_from[0] == 50
    few = toxicity.fit_toxicity(docs, known, max_terms=500).learnt_from
    assert 0 < few[0] < 300 and few[1] <= 500


def test_rare_words_that_tell_only_together():
    for insult, group, base in ((0.02, 0.3, 0.1), (0.02, 0.1, 0.2), (0.05, 0.05, 0.3)):
        rng, rows, labels = np.random.default_rng(1), [], []
        for _ in range(8000):
            a, b = rng.random() < insult, rng.random() < group
            words = [f"w{j}" for j in rng.zipf(1.3, 30) % 3000] + ["insult"] * a + ["group"] * b
            rows.append(toxicity.terms(" ".join(words).encode()))
            labels.append(float(a and b or rng.random() < base))
        model = toxicity.FactorizationMachine().fit(rows, np.array(labels, np.float32))
        both, one, other = model.score([toxicity.terms(t) for t in (b"insult group", b"insult", b"group")])
        assert both > 0.6 and one < base + 0.15 and other < base + 0.15
