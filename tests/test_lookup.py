import numpy as np
import pytest
from pyspark.sql import functions as F

from broadloom.operators import encode as E, lookup as K
from broadloom.operators.profile import (
    column_stats, constant_columns, correlated_columns, greedy_correlation_filter, identical_columns, impute_median, rare_flags)


@pytest.fixture(scope="module")
def skewed(spark):
    level = F.when(F.col("id") % 17 == 0, None).when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("l"), (F.col("id") % 40).cast("string")))
    return spark.range(2000).select("id", level.alias("c"), (F.col("id") % 2 == 0).alias("train"))


@pytest.mark.parametrize("limit", [1000, 5])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_join_paths_agree(skewed, limit, how):
    d = skewed.filter("c is not null and c <> 'l7'").groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    got = sorted(map(tuple, K.lookup_join(skewed.select("id", "c"), d, "c", how=how, max_rows=limit)
                     .select("id", "c", "n").collect()))
    want = sorted(map(tuple, skewed.select("id", "c").join(d, "c", how).select("id", "c", "n").collect()))
    assert got == want


@pytest.mark.parametrize("limit", [1000, 5])
def test_levels_paths_agree(skewed, limit):
    levels = K.Levels(skewed, ["c"], "id", F.col("train"), max_rows=limit).number()
    out = levels.attach(skewed, "c", code="code", freq="n").collect()
    names = sorted({r["c"] for r in out if r["c"] is not None})
    for r in out:
        assert r["code"] == (names.index(r["c"]) if r["c"] is not None else None)
    assert sum(r["freq"] is None for r in out) == sum(r["c"] is None for r in out)


def test_dense_codes_in_ranges(skewed):
    lv = K.level_table(skewed, ["c"], "id")
    a = {r["level"]: r["code"] for r in K.dense_codes(lv).collect()}
    b = {r["level"]: r["code"] for r in K.dense_codes(lv, max_window=3).collect()}
    c = {r["level"]: r["code"] for r in K.dense_codes(lv, by="first_key", start=1, max_window=3).collect()}
    assert a == b and a == {n: i for i, n in enumerate(sorted(a))}
    first = {r["level"]: r["first_key"] for r in lv.collect()}
    assert c == {n: i + 1 for i, n in enumerate(sorted(first, key=first.get))}


def test_collapse_and_na(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "a", 0), (4, "z", 0), (5, None, 1)], "id int, c string, tc int")
    out = {r["id"]: r["c"] for r in E.collapse_levels(df, ["c"], "id", F.col("tc") == 1).collect()}
    assert out == {1: "a", 2: "other", 3: "a", 4: "other", 5: "other"}
    assert E.na_level(df, ["c"]).filter("c = '__NA__'").count() == 1


def test_one_hot_forms(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, c string")
    rows = {r["id"]: (r["c_a"], r["c_b"]) for r in E.one_hot(df, "c").collect()}
    assert rows == {1: (1, 0), 2: (0, 1), 3: (0, 0)}
    vec = {r["id"]: list(r["v"].toArray()[:2]) for r in E.one_hot_vector(df, "c", "v").collect()}
    assert vec[1] == [1.0, 0.0] and vec[2] == [0.0, 1.0]


def test_joined_text_is_one_row_per_group(spark):
    df = spark.range(60).select((F.col("id") % 3).alias("g"), F.col("id").alias("i"))
    out = E.joined_text(df, "g", "i", (F.col("g") < 2) & (F.col("i") % 2 == 0)).collect()
    assert len(out) == 3
    items = {g: sorted(int(x) for r in out if r["g"] == g and r["items"] != "None" for x in r["items"].split()) for g in range(3)}
    assert items == {g: [i for i in range(60) if i % 3 == g and g < 2 and i % 2 == 0] for g in range(3)}
    assert [r["items"] for r in out if r["g"] == 2] == ["None"]


def test_fingerprint_is_injective(spark):
    from broadloom.functions.columns import fingerprint
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "x"), ("-", "x"), ("", "x")], "a string, b string")
    assert df.select(fingerprint(["a", "b"]).alias("h")).distinct().count() == 5


def test_duplicate_rows(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 3.0), ("b", 1, 5.0), ("a", 1, 5.0)], "c string, f int, y double")
    g = E.duplicate_groups(df, ["c", "f"], "y").collect()
    assert len(g) == 1 and g[0]["n"] == 3 and g[0]["avg_y"] == 3.0 and g[0]["sd_y"] == 2.0
    assert E.duplicate_rows(df, ["c", "f"], "y").count() == 3


def test_profile_edges(spark):
    df = spark.range(100).selectExpr("id", "1 as one", "cast(null as int) as none", "id % 2 as flag",
                                     "cast(id % 2 as double) as same", "if(id = 5, null, 3) as gap")
    cols = ["one", "none", "flag", "same", "gap"]
    assert constant_columns(df, cols) == ["one", "none"]
    assert rare_flags(df, ["one", "flag", "none"], 60) == ["flag", "none"]
    assert identical_columns(df.withColumn("copy", F.col("flag")), ["flag", "one", "copy"], "id") == [("flag", "copy")]
    wide = df.select("id", *[(F.col("id") % (i + 1)).alias(f"c{i}") for i in range(60)])
    names = [f"c{i}" for i in range(60)]
    flat = {r["column"]: r for r in column_stats(wide, names[:3]).collect()}
    long = {r["column"]: r for r in column_stats(wide, names).collect()}
    assert len(long) == 60 and all(abs(flat[c]["sd"] - long[c]["sd"]) < 1e-12 and flat[c]["max"] == long[c]["max"] for c in flat)
    filled = impute_median(df.withColumn("gap", F.when(F.col("id") > 3, F.col("id")).cast("double")), ["gap", "none"])
    assert filled.filter("gap is null").count() == 0 and filled.filter("none is null").count() == 100
    assert filled.filter("id = 0").first()["gap"] == 51.5


def test_correlation_filters():
    r = [[1, .97, .1], [.97, 1, .2], [.1, .2, 1]]
    assert correlated_columns(r, ["a", "b", "c"]) == ["b"]
    assert greedy_correlation_filter(r, ["a", "b", "c"]) == ["b"]
    assert correlated_columns([[1, -.99], [-.99, 1]], ["a", "b"]) == []
    assert greedy_correlation_filter([[1, -.99], [-.99, 1]], ["a", "b"]) == ["b"]
    rng = np.random.default_rng(0)
    for _ in range(20):
        z = rng.normal(size=(50, 5))
        r = np.corrcoef(np.column_stack([z[:, :2], z, z[:, 4]]).T)      # copies: the later twin goes, whatever the noise
        assert sorted(greedy_correlation_filter(r, list("abcdefgh"))) == ["c", "d", "h"]
