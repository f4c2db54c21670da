import numpy as np
import pytest
from pyspark.sql import functions as F

from broadloom.functions.columns import hash52
from broadloom.operators import ordering as O


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 3000
    key = rng.permutation(n * 3)[:n]
    v = np.where(rng.random(n) < 0.35, 7.0, rng.normal(0, 10, n).round(1))   # one value fills a third
    rows = [(int(k), float(x), None if i % 10 == 0 else float(x) * 2) for i, (k, x) in enumerate(zip(key, v))]
    return spark.createDataFrame(rows, "k bigint, v double, w double").repartition(5), key, v, rows


@pytest.mark.parametrize("size", [10**6, 200])
def test_order_statistics(data, size):
    df, key, v, rows = data
    ranks = [0, 1, 777, 1500, 2999]
    got, counts = O.order_statistics(df, {"k": ranks, "v": ranks, "w": [0, 100]}, size)
    sv, sk = np.sort(v), np.sort(key)
    sw = np.sort([r[2] for r in rows if r[2] is not None])
    assert counts == {"k": 3000, "v": 3000, "w": 2700}
    assert all(got["v"][r] == sv[r] and got["k"][r] == sk[r] for r in ranks)
    assert all(got["w"][r] == sw[r] for r in (0, 100))


@pytest.mark.parametrize("size", [10**6, 200])
def test_quantiles(data, size):
    df, _, v, rows = data
    q = O.exact_quantiles(df, {"v": [0.0, 0.1, 0.5, 0.93, 1.0], "w": [0.5]}, size)
    assert all(abs(q["v"][p] - np.quantile(v, p)) < 1e-12 for p in q["v"])
    assert abs(q["w"][0.5] - np.median([r[2] for r in rows if r[2] is not None])) < 1e-12


def test_quantile_of_nothing(spark):
    df = spark.createDataFrame([(None,), (None,)], "a double")
    assert O.exact_quantiles(df, {"a": [0.5]}) == {"a": {0.5: None}}


@pytest.mark.parametrize("size", [10**6, 200])
@pytest.mark.parametrize("k", [2, 5, 7])
def test_contiguous_folds(data, size, k):
    df, key, _, _ = data
    got = {r["k"]: r["fold"] for r in O.contiguous_folds(df, "k", k, rows_per_bucket=size).collect()}
    order = np.sort(key)
    want = {int(x): f for f, part in enumerate(np.array_split(order, k)) for x in part}
    assert got == want


def test_more_folds_than_rows(spark):
    df = spark.range(3)
    assert sorted(r["fold"] for r in O.contiguous_folds(df, "id", 5).collect()) == [0, 1, 2]


@pytest.mark.parametrize("size", [10**6, 200])
def test_slice_index_running(data, size):
    df, key, v, _ = data
    order = np.argsort(key)
    got = sorted(r["k"] for r in O.rank_slice(df, "k", 100, 1234, size).collect())
    assert got == [int(x) for x in np.sort(key)[100:1234]]
    assert O.rank_slice(df, "k", 5000, 6000, size).count() == 0
    idx = {r["k"]: r["idx"] for r in O.ordered_index(df, "k", rows_per_bucket=size).collect()}
    assert idx == {int(key[o]): i for i, o in enumerate(order)}
    run = {r["k"]: r for r in O.running(df, "k", "v", size).collect()}
    mean = np.cumsum(v[order]) / np.arange(1, len(v) + 1)
    top = np.maximum.accumulate(v[order])
    for i, o in enumerate(order):
        r = run[int(key[o])]
        assert abs(r["run_mean"] - mean[i]) < 1e-9 and r["run_max"] == top[i] and r["run_n"] == i + 1


@pytest.mark.parametrize("size", [10**6, 200])
@pytest.mark.parametrize("n", [1, 400, 2999, 5000])
def test_smallest_and_sample(data, size, n):
    df, key, v, _ = data
    pairs = sorted((x, int(k)) for k, x in zip(key, v))
    got = sorted((r["v"], r["k"]) for r in O.smallest(df, "v", "k", n, size).collect())
    assert got == pairs[:n]
    hashed = [r["k"] for r in df.withColumn("h", hash52("k", seed=4)).orderBy("h", "k").limit(n).collect()]
    assert sorted(r["k"] for r in O.hash_sample(df, "k", n, 4, size).collect()) == sorted(hashed)


@pytest.mark.parametrize("size", [10**6, 50])
def test_group_index_with_a_hot_group(spark, size):
    df = spark.range(3000).withColumn("g", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") == 1, None)
                                      .otherwise((F.col("id") % 50).cast("string")))
    out = O.group_index(df, "g", "id", 5, rows_per_bucket=size).withColumn("h", hash52("id", seed=5)).collect()
    assert len(out) == 3000
    groups = {}
    for r in out:
        groups.setdefault(r["g"], []).append((r["h"], r["id"], r["idx"], r["group_n"]))
    for rows in groups.values():
        rows.sort()
        assert [r[2] for r in rows] == list(range(len(rows))) and {r[3] for r in rows} == {len(rows)}


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 7])
def test_keys_beyond_double_precision_and_of_other_types(spark, rows_per_bucket):
    from pyspark.sql import functions as F

    from broadloom.operators.ordering import contiguous_folds, ordered_index, rank_slice

    base = spark.range(40).select((F.col("id") + F.lit(2 ** 60)).alias("big"), F.format_string("k%05d", "id").alias("text"),
                                  F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    for key in ("big", "text", "day"):
        folds = [r["fold"] for r in contiguous_folds(base, key, 5, rows_per_bucket=rows_per_bucket).orderBy(key).collect()]
        assert folds == [i // 8 for i in range(40)]
        every = [r[key] for r in base.orderBy(key).collect()]
        assert [r[key] for r in rank_slice(base, key, 3, 9, rows_per_bucket).orderBy(key).collect()] == every[3:9]
        assert [r["idx"] for r in ordered_index(base, key, rows_per_bucket=rows_per_bucket).orderBy(key).collect()] == list(range(40))


@pytest.mark.parametrize("size", [10**6, 100, 4])
def test_null_keys_stay_and_come_first(spark, size):
    rows = [(None if i % 100 == 3 else i, float(i % 7)) for i in range(1000)]
    df = spark.createDataFrame(rows, "k bigint, v double").repartition(3)
    got = sorted((r.idx, r.k) for r in O.ordered_index(df, "k", rows_per_bucket=size).collect())
    assert got == list(enumerate([None] * 10 + [k for k, _ in rows if k is not None]))
    run = O.running(df, "k", "v", rows_per_bucket=size).collect()
    assert len(run) == 1000 and max(r.run_n for r in run) == 1000
    first = sum(v for k, v in rows if k is None)
    for r in run:
        if r.k is not None:
            assert abs(r.run_sum - first - sum(v for k, v in rows if k is not None and k <= r.k)) < 1e-9


def test_nan_keys_come_last(spark):
    df = spark.createDataFrame([(float("nan") if i == 5 else float(i), i) for i in range(200)], "k double, i int")
    for size in (10**6, 10):
        assert {r.idx for r in O.ordered_index(df, "k", rows_per_bucket=size).filter("i = 5").collect()} == {199}


@pytest.mark.parametrize("size", [10**6, 100])
def test_keys_with_a_long_common_beginning(spark, size):
    keys = [f"https://www.example.org/{'é' if i % 5 == 0 else 'a'}/{i:05d}" for i in range(2000)]
    df = spark.createDataFrame([(k,) for k in keys], "k string").repartition(4)
    order = sorted(keys, key=lambda k: k.encode())
    assert [r.k for r in O.ordered_index(df, "k", rows_per_bucket=size).orderBy("idx").collect()] == order
    _, bounds = O._bounds(df, ["k"], 100)
    sizes = [r["count"] for r in O.with_bucket(df, bounds).groupBy("k__b").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 500
    assert O.order_statistics(df, {"k": [0, 999]}, size)[0]["k"] == {0: order[0], 999: order[999]}
