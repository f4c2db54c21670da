import numpy as np
from pyspark.sql import functions as F

from broadloom.llm import ann


def plain(rows, wanted, k=20):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) == 8
          and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in ok:
        if wanted(q):
            out[q] = sorted(((-float(ok[q] @ ok[i]), i) for i in ok if i != q))[:k]
    return out


def test_recall_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + 0.4 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(1500)]
    rows = [(i, v if i % 4 else rows[3][1]) for i, v in rows]  # a quarter of all is one vector
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [1.0] * 7 + [None]), (2003, [float("nan")] * 8), (2004, [float("inf")] + [0.0] * 7),
             (2005, [1.0, 2.0]), (None, [1.0] * 8), (2006, [-0.0] * 7 + [1.0]), (2007, [0.0] * 7 + [1.0]), rows[5]]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id bigint, embedding array<float>, score int")
    index = ann.build_index(df, per_list=40)
    got = {}
    for r in ann.search(index, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = plain(rows, lambda i: i % 20 == 0)
    assert set(got) == set(want)
    hit = 0
    for q, v in want.items():
        g = sorted(got[q])
        assert [x[0] for x in g] == list(range(1, 21)) and q not in {x[1] for x in g}
        assert g == sorted(g, key=lambda x: (-x[2], x[1]))
        hit += len({x[1] for x in g} & {i for _, i in v})
    assert hit / (20 * len(want)) >= 0.9


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id bigint, embedding array<double>")
    got = [tuple(r) for r in ann.search(ann.build_index(df), F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert ann.search(ann.build_index(df.limit(0)), F.lit(True)).collect() == []


def test_lists_beyond_the_first_are_found(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(6000, 8)))]  # no clusters, 375 lists
    index = ann.build_index(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), per_list=16, recall=1.0)
    assert len(index.centroids) == 375
    got = {}
    for r in ann.search(index, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert got == {q: {i for _, i in v} for q, v in plain(rows, lambda i: i % 20 == 0).items()}


def test_ratio_prunes_lists_and_keeps_the_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 8))
    rows = [(i, (centres[rng.integers(0, 40)] * rng.uniform(0.5, 1.5) + 0.3 * rng.normal(size=8)).tolist()) for i in range(8000)]
    index = ann.build_index(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), per_list=100)
    sizes = [r["count"] for r in index.postings.groupBy("list").count().collect()]
    assert len(sizes) > 70 and max(sizes) <= 2.5 * sum(sizes) / len(sizes)
    assert 1 < index.ratio < 3 and index.beam < len(index.centroids)
    got = {}
    for r in ann.search(index, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = plain(rows, lambda i: i % 20 == 0)
    assert sum(len(got[q] & {i for _, i in v}) for q, v in want.items()) >= 0.9 * 20 * len(want)
