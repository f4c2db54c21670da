import hashlib

import numpy as np

from broadloom.llm import simplex_clusters as S
from broadloom.llm.queries import TEXT_QUERIES
from check import compare, views


def plain(rows, dim, k, rounds, scale):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in start]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, a) in zip(kept, at) if a == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine)]
    at = assign()
    total = {j: sum(d for d, a in at if a == j) for j in range(len(centroids))}
    return sorted(((i, j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest())
                   for (i, _), (d, j) in zip(kept, at)), key=str)


def test_equals_plain_clustering(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 6))
    rows = [(i, (centres[i % 5] + 0.3 * rng.normal(size=6)).tolist()) for i in range(600)]
    rows = [(i, v if i % 3 else rows[1][1]) for i, v in rows]  # a third is one vector
    rows += [(7, rows[8][1]), rows[9], rows[9], (None, [0.5] * 6), (601, None), (602, [1.0] * 5), (603, [1.0] * 5 + [None]),
             (604, [float("nan")] * 6), (605, [float("inf")] * 6), (606, [0.0] * 6), (607, [-3e38] * 6), (608, [900.0, -900.0] * 3)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<double>, cluster int, distance string").repartition(3)
    got = S.cluster_vectors(df, dim=6, k=9, rounds=5)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain([r for r in rows if r[0] != 607], 6, 9, 5, 256)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [9.0, 0.0])], "vec_id bigint, embedding array<float>")
    assert sorted(r.cluster for r in S.cluster_vectors(df, dim=2).collect()) == sorted(r[1] for r in plain(
        [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [9.0, 0.0])], 2, 40, 5, 256))
    none = S.cluster_vectors(df, dim=3)
    assert none.collect() == [] and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(0)
    centroids = rng.integers(-300, 300, (12, 20))
    vectors = (centroids[rng.integers(0, 12, 500)] + rng.integers(-60, 60, (500, 20))).astype(np.int64)
    simplex = S.Simplex(centroids[:8])
    open_ = S.possible(simplex.apexes(vectors).astype(np.float32), simplex.apexes(centroids))
    exact = ((vectors[:, None] - centroids[None]) ** 2).sum(2)
    assert open_[np.arange(500), exact.argmin(1)].all()
    assert open_.mean() < 0.5


def test_query_equals_sql(spark, sf):
    q = TEXT_QUERIES["op11_simplex_clusters"]
    assert compare(q.build(spark, sf), views(sf), q.sql) is None
