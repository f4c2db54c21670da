"""Sources, sinks, projections, filters, joins, sets, sorts and row features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from broadloom.functions import columns as C
from broadloom.operators import encode as E
from broadloom.operators.lookup import Levels, lookup_join
from broadloom.operators.ordering import hash_sample, rank_slice
from broadloom.plans.fixtures import FLAGS, dup_source, table, wide, with_wide
from broadloom.plans.registry import query
from broadloom.session import durable, new_path
from broadloom.sources import readers as R, writers as Wr

DUP_FEATURES = ["l_returnflag", "l_linestatus", "l_linenumber", "qty"]
DUP_HASH = ("md5(concat_ws('|', " + ", ".join(
    f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    for c in ["l_returnflag", "l_linestatus", "l_linenumber", "CAST(l_quantity AS INTEGER)"]) + "))")
DUP_GROUPS = (f"SELECT {DUP_HASH} AS hash, count(*) AS n, avg(l_extendedprice) AS a, "
              "stddev_samp(l_extendedprice) AS s FROM lineitem GROUP BY 1 HAVING count(*) > 1")


@query("SCL-3 AGG-1 AGG-2 ORD-1 ENC-12",
       f"SELECT hash, n, round(a, 4) AS avg_y, round(s, 4) AS sd_y FROM ({DUP_GROUPS}) ORDER BY n DESC, hash")
def dup_rows(spark: SparkSession, sf: str) -> DataFrame:
    out = E.duplicate_groups(dup_source(spark, sf), DUP_FEATURES, "y")
    return out.withColumns({"avg_y": F.round("avg_y", 4), "sd_y": F.round("sd_y", 4)}).orderBy(F.desc("n"), "hash")


@query("EVL-6",
       f"SELECT g.hash, l_extendedprice AS y, n, round(a, 4) AS avg_y, round(s, 4) AS sd_y "
       f"FROM lineitem JOIN ({DUP_GROUPS}) g ON g.hash = {DUP_HASH}")
def dup_rows_joined(spark, sf):
    out = E.duplicate_rows(dup_source(spark, sf), DUP_FEATURES, "y")
    return out.withColumns({"avg_y": F.round("avg_y", 4), "sd_y": F.round("sd_y", 4)})


@query("SRC-1 SNK-1", "SELECT o_orderkey AS ID, o_totalprice AS y FROM orders")
def scan_csv_roundtrip(spark, sf):
    path = new_path(spark, "submission.csv")
    Wr.write_csv(table(spark, sf, "orders").select(F.col("o_orderkey").alias("ID"), F.col("o_totalprice").alias("y")), path)
    return R.read_csv(spark, path, "ID bigint, y double")


@query("SRC-4 SNK-2", "SELECT p_partkey, p_brand, p_size, p_retailprice FROM part")
def parquet_roundtrip(spark, sf):
    path = new_path(spark, "part")
    Wr.write_table(table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice"), path)
    return R.read_table(spark, path)


@query("SRC-2", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_flatten(spark, sf):
    return R.flatten_json(table(spark, sf, "events").select("event_id", "props"), "props", "k int")


@query("SRC-2", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IS NOT NULL")
def json_nested_records(spark, sf):
    path = new_path(spark, "answers")
    answers = F.collect_list(F.struct("o_orderkey", "o_totalprice")).alias("answers")
    table(spark, sf, "orders").filter("o_custkey is not null").groupBy("o_custkey").agg(answers).write.json(path)
    return R.read_json(spark, path, "answers array<struct<o_orderkey: bigint, o_totalprice: double>>", "answers", lines=True)


def predictions_long(df: DataFrame, *keep: str) -> DataFrame:
    """Three closed-form predictors of y: mean by X0, mean by X1, straight line in X22."""
    df = durable(df)
    line = df.agg(F.regr_slope("y", "X22").alias("b"), F.regr_intercept("y", "X22").alias("a")).first()
    slope, base = line["b"] or 0.0, line["a"] if line["a"] is not None else 0.0
    out = df
    for c in ("X0", "X1"):
        means = df.groupBy(c).agg(F.avg("y").alias(f"mean_{c}"), F.count(F.lit(1)).alias("w"))
        out = lookup_join(out, means, c).drop("w")
    return out.select("ID", *keep, F.explode(F.array(
        F.struct(F.lit("mean_X0").alias("model"), F.col("mean_X0").alias("pred")),
        F.struct(F.lit("mean_X1").alias("model"), F.col("mean_X1").alias("pred")),
        F.struct(F.lit("line_X22").alias("model"), (F.lit(base) + F.lit(slope) * F.col("X22")).alias("pred")),
    )).alias("s")).select("ID", *keep, "s.*")


MODELS = ["mean_X0", "mean_X1", "line_X22"]
PREDS_WIDE_CTE = """line AS (SELECT regr_slope(y, X22) AS b, regr_intercept(y, X22) AS a FROM wide),
preds AS (SELECT ID, y, avg(y) OVER (PARTITION BY X0) AS mean_X0, avg(y) OVER (PARTITION BY X1) AS mean_X1,
    (SELECT a FROM line) + (SELECT b FROM line) * X22 AS line_X22 FROM wide)"""


@query("SRC-3 JN-6", with_wide("""SELECT ID, round(mean_X0, 4) AS "mean_X0", round(mean_X1, 4) AS "mean_X1",
    round(line_X22, 4) AS "line_X22" FROM preds""", PREDS_WIDE_CTE))
def pred_dir_pivot(spark, sf):
    path = new_path(spark, "layer1")
    Wr.write_predictions(predictions_long(wide(spark, sf, "ID", "y", "X0", "X1", "X22")), path, MODELS)
    out = R.pivot_predictions(R.read_predictions(spark, path), MODELS)
    return out.select("ID", *[F.round(m, 4).alias(m) for m in MODELS])


@query("SRC-6", with_wide("""SELECT z, j, count(*) AS n, sum(CAST(X14 = 1 AS BIGINT))::BIGINT AS big, round(avg(y), 4) AS mean_y
    FROM wide, (SELECT unnest([1, 2, 3, 4]) AS z), (SELECT unnest([2, 4, 6]) AS j)
    WHERE X22 >= z AND X22 <= z + j GROUP BY z, j"""))
def param_grid(spark, sf):
    rows = wide(spark, sf, "y", "X14", "X22").groupBy("X22").agg(
        F.count(F.lit(1)).alias("n"), F.sum("X14").alias("big"), F.sum("y").alias("sy"))
    grid = R.param_grid(rows, {"z": [1, 2, 3, 4], "j": [2, 4, 6]})
    hit = grid.filter((F.col("X22") >= F.col("z")) & (F.col("X22") <= F.col("z") + F.col("j")))
    return hit.groupBy("z", "j").agg(F.sum("n").alias("n"), F.sum("big").alias("big"),
                                     F.round(F.sum("sy") / F.sum("n"), 4).alias("mean_y"))


@query("PRJ-1 PRJ-2 PRJ-3 PRJ-4 PRJ-5 PRJ-6 PRJ-7",
       with_wide("""SELECT ID AS key, tc, X10, X11, X12, X13, X14, X15, X16, X17 FROM wide WHERE tc = 0"""))
def select_aligned(spark, sf):
    full = wide(spark, sf)
    train = full.filter("tc = 1").drop("y_lin", "y_out", "X18", "X19")
    numeric = train.select(*C.numeric_columns(train, exclude=("y",)))
    flags = numeric.select("ID", "tc", *C.columns_matching(numeric, r"^X1[0-9]$"))
    first = flags.select(*flags.columns[0:2], *C.other_columns(flags, "ID", "tc"))
    return full.filter("tc = 0").select(*first.columns).withColumnRenamed("ID", "key")


@query("PRJ-8 SET-1 SET-2", """SELECT o_orderkey AS ID, o_totalprice AS y,
    CAST(o_orderkey % 2 = 0 AS INTEGER) AS tc FROM orders""")
def tag_union_split(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("ID"), F.col("o_totalprice").alias("y"))
    train = orders.filter("ID % 2 = 0").withColumn("tc", F.lit(1))
    test = orders.filter("ID % 2 = 1").withColumn("tc", F.lit(0))
    both = train.unionByName(test)
    return both.filter("tc = 1").unionByName(both.filter("tc = 0"))


@query("SRC-5 JN-2", """SELECT o.k AS o_custkey, c_acctbal FROM (SELECT DISTINCT o_custkey AS k FROM orders) o
    LEFT JOIN customer ON c_custkey = o.k""")
def key_skeleton(spark, sf):
    skeleton = R.key_skeleton(table(spark, sf, "orders"), "o_custkey")
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    return skeleton.join(cust, "o_custkey", "left")


@query("PRJ-10 SCL-2 ENC-10", with_wide("""SELECT ID, CASE X10 || '_' || X11 || '_' || X12
    WHEN '0_0_0' THEN 'Group 1' WHEN '1_1_1' THEN 'Group 2' WHEN '1_1_0' THEN 'Group 2' WHEN '0_1_1' THEN 'Group 2'
    WHEN '0_0_1' THEN 'Group 3' WHEN '1_0_1' THEN 'Group 4' WHEN '1_0_0' THEN 'Group 4' ELSE 'Group X' END AS grp
    FROM wide"""))
def case_group(spark, sf):
    return E.triple_group(wide(spark, sf, "ID", "X10", "X11", "X12"), ["X10", "X11", "X12"]).select("ID", "grp")


@query("PRJ-9 PRJ-11", with_wide("""SELECT ID, round(66.5386547916928::DOUBLE + CAST(X5 = 'ASIA' AS INTEGER)
    + 25.4051960894959::DOUBLE * X14 + 7.89681427726105::DOUBLE * X15 + 4.84424759927184::DOUBLE * X16
    + (1.39519609054033::DOUBLE + X10) / (0.123227966633056::DOUBLE + X11) - CAST(X5 = 'EUROPE' AS INTEGER), 6) AS feat
    FROM wide"""))
def formula_feature(spark, sf):
    df = wide(spark, sf, "ID", "X5", "X10", "X11", "X14", "X15", "X16")
    feat = E.mined_feature(C.is_value("X5", "ASIA"), C.is_value("X5", "EUROPE"), ["X14", "X15", "X16"], "X10", "X11")
    return df.select("ID", F.round(feat, 6).alias("feat"))


@query("PRJ-12 ENC-9", with_wide("""SELECT ID, X10 + X11 + X12 AS rules_group1, X13 + X14 + X15 AS rules_group2,
    X16 + X17 AS rules_group3 FROM wide"""))
def group_sum(spark, sf):
    groups = {"rules_group1": ["X10", "X11", "X12"], "rules_group2": ["X13", "X14", "X15"], "rules_group3": ["X16", "X17"]}
    return E.group_sums(wide(spark, sf, "ID", *FLAGS), groups).select("ID", *groups)


@query("PRJ-13 PRJ-14", """SELECT c_custkey, abs(c_acctbal) AS bal_abs, CAST(c_acctbal > 0 AS INTEGER) AS positive,
    CAST(c_nationkey AS VARCHAR) AS nation_level, CAST(c_acctbal AS BOOLEAN) AS has_bal,
    TRY_CAST(substr(c_name, 10) AS DOUBLE) AS name_number FROM customer""")
def cast_abs(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", F.abs("c_acctbal").alias("bal_abs"), (F.col("c_acctbal") > 0).cast("int").alias("positive"),
        F.col("c_nationkey").cast("string").alias("nation_level"), F.col("c_acctbal").cast("boolean").alias("has_bal"),
        F.substring("c_name", 10, 100).try_cast("double").alias("name_number"))


@query("FLT-1 FLT-2 FLT-4", """SELECT ID, y, part FROM (
    SELECT o_orderkey AS ID, o_totalprice AS y, row_number() OVER (ORDER BY o_orderkey) AS rn,
           count(*) OVER () AS n, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= count(*) OVER () * 4 // 5
           THEN 'train' ELSE 'holdout' END AS part FROM orders) WHERE y > 1500 AND y IS NOT NULL""")
def holdout_slice(spark, sf):
    df = table(spark, sf, "orders").select(F.col("o_orderkey").alias("ID"), F.col("o_totalprice").alias("y"))
    n = df.count()
    keep = (F.col("y") > 1500) & F.col("y").isNotNull()
    train = rank_slice(df, "ID", 0, n * 4 // 5).filter(keep).withColumn("part", F.lit("train"))
    rest = rank_slice(df, "ID", n * 4 // 5, n).filter(keep).withColumn("part", F.lit("holdout"))
    return train.unionByName(rest)


SAMPLE_SQL = """(SELECT o_orderkey FROM orders
    ORDER BY ('0x' || substr(md5(o_orderkey || '|11'), 1, 13))::BIGINT, o_orderkey LIMIT 400)"""


@query("FLT-5 SMP-3 JN-4", f"""SELECT o_orderkey, o_orderpriority FROM orders
    WHERE o_orderkey NOT IN {SAMPLE_SQL}""")
def anti_sample(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return orders.join(hash_sample(orders.select("o_orderkey"), "o_orderkey", 400, 11), "o_orderkey", "left_anti")


@query("SMP-3 JN-3 FLT-3", f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN {SAMPLE_SQL}")
def fixed_size_sample(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return orders.join(hash_sample(orders.select("o_orderkey"), "o_orderkey", 400, 11), "o_orderkey", "left_semi")


@query("JN-1 AGG-11", with_wide("""SELECT ID, X0_code, X3_code FROM wide
    JOIN (SELECT X0 AS v, CAST(row_number() OVER (ORDER BY X0) - 1 AS INTEGER) AS X0_code FROM (SELECT DISTINCT X0 FROM wide)) a
      ON X0 = a.v
    JOIN (SELECT X3 AS v, CAST(row_number() OVER (ORDER BY X3) - 1 AS INTEGER) AS X3_code FROM (SELECT DISTINCT X3 FROM wide)) b
      ON X3 = b.v"""))
def dict_join(spark, sf):
    df = wide(spark, sf, "ID", "X0", "X3")
    levels = Levels(df, ["X0", "X3"], "ID").number()
    for c in ("X0", "X3"):
        df = levels.attach(df, c, **{f"{c}_code": "code"}).filter(F.col(f"{c}_code").isNotNull())
    return df.select("ID", "X0_code", "X3_code")


@query("WIN-2 ENC-4", with_wide("SELECT w.ID" + "".join(f", {c}_code" for c in ("X0", "X1", "X3", "X5")) + " FROM wide w" + "".join(
    f""" JOIN (SELECT {c} AS v, CAST(row_number() OVER (ORDER BY min(ID)) AS INTEGER) AS {c}_code
    FROM wide GROUP BY {c}) d{c} ON d{c}.v = w.{c}""" for c in ("X0", "X1", "X3", "X5"))))
def first_seen_code(spark, sf):
    return E.first_seen_encode(wide(spark, sf, "ID", "X0", "X1", "X3", "X5"), ["X0", "X1", "X3", "X5"], "ID")


CODED = ["X0", "X1", "X2", "X3", "X4", "X5", "X6"]


@query("WIN-1 ENC-1", with_wide("SELECT w.ID" + "".join(f", {c}_code" for c in CODED) + " FROM wide w" + "".join(
    f""" LEFT JOIN (SELECT {c} AS v, CAST(row_number() OVER (ORDER BY {c}) - 1 AS INTEGER) AS {c}_code
    FROM wide WHERE {c} IS NOT NULL GROUP BY {c}) d{c} ON d{c}.v = w.{c}""" for c in CODED)))
def label_encode(spark, sf):
    return E.label_encode(wide(spark, sf, "ID", *CODED), CODED, "ID").drop(*CODED)


@query("JN-5 ENC-2", with_wide("SELECT ID, " + ", ".join(
    f"CASE WHEN {c} IS NOT NULL THEN count(*) OVER (PARTITION BY {c}) END AS {c}_freq" for c in CODED) + " FROM wide"))
def freq_encode(spark, sf):
    return E.frequency_encode(wide(spark, sf, "ID", *CODED), CODED, "ID").drop(*CODED)


@query("ENC-2", with_wide("SELECT ID, " + ", ".join(
    f"sum(tc::BIGINT) OVER (PARTITION BY {c})::BIGINT AS {c}_freq" for c in ("X0", "X4")) + " FROM wide"))
def freq_encode_train(spark, sf):
    df = wide(spark, sf, "ID", "tc", "X0", "X4")
    return E.frequency_encode(df, ["X0", "X4"], "ID", F.col("tc") == 1, "train").drop("X0", "X4", "tc")


@query("SET-3 SCL-6 ENC-3", with_wide("""SELECT ID,
    CASE WHEN X4 IN (SELECT X4 FROM wide WHERE tc = 1 INTERSECT SELECT X4 FROM wide WHERE tc = 0) THEN X4 ELSE 'other' END AS X4,
    CASE WHEN X6 IN (SELECT X6 FROM wide WHERE tc = 1 INTERSECT SELECT X6 FROM wide WHERE tc = 0) THEN X6 ELSE 'other' END AS X6
    FROM wide"""))
def collapse_levels(spark, sf):
    df = wide(spark, sf, "ID", "tc", "X4", "X6")
    return E.collapse_levels(df, ["X4", "X6"], "ID", F.col("tc") == 1).select("ID", "X4", "X6")


@query("SET-3 SET-4 JN-4", with_wide("""SELECT level, side FROM (
    SELECT DISTINCT X4 AS level, 'both' AS side FROM wide WHERE tc = 1 AND X4 IN (SELECT X4 FROM wide WHERE tc = 0)
    UNION ALL SELECT DISTINCT X4, 'train_only' FROM wide WHERE X4 NOT IN (SELECT X4 FROM wide WHERE tc = 0)
    UNION ALL SELECT DISTINCT X4, 'test_only' FROM wide WHERE X4 NOT IN (SELECT X4 FROM wide WHERE tc = 1))"""))
def level_sets(spark, sf):
    levels = durable(wide(spark, sf, "tc", "X4").withColumnRenamed("X4", "level").distinct())
    train, test = (levels.filter(f"tc = {t}").select("level") for t in (1, 0))
    return (train.intersect(test).withColumn("side", F.lit("both"))
            .unionByName(train.subtract(test).withColumn("side", F.lit("train_only")))
            .unionByName(test.join(train, "level", "left_anti").withColumn("side", F.lit("test_only"))))


@query("ENC-5 SCL-6", with_wide("SELECT ID, coalesce(X6, '__NA__') AS X6 FROM wide"))
def na_level(spark, sf):
    return E.na_level(wide(spark, sf, "ID", "X6"), ["X6"])


@query("ENC-6", with_wide("""SELECT ID, CAST(X2 = 'F' AS INTEGER) AS "X2_F", CAST(X2 = 'O' AS INTEGER) AS "X2_O",
    CAST(X2 = 'P' AS INTEGER) AS "X2_P" FROM wide"""))
def one_hot(spark, sf):
    return E.one_hot(wide(spark, sf, "ID", "X2"), "X2").drop("X2")


@query("AGG-12", """SELECT l_orderkey, coalesce(nullif(string_agg(CAST(p AS VARCHAR), ' ' ORDER BY p), ''), 'None') AS items
    FROM (SELECT DISTINCT l_orderkey, CASE WHEN l_discount > 0.05::DOUBLE THEN l_partkey END AS p FROM lineitem)
    GROUP BY l_orderkey""")
def group_concat_none(spark, sf):
    return E.joined_text(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey", F.col("l_discount") > 0.05)


@query("AGG-14 SCL-5 ENC-8", with_wide(f"""SELECT ID, CAST({' + '.join(FLAGS)} AS INTEGER) AS flag_sum,
    CAST(list_max(list_transform(string_split({' || '.join(FLAGS)}, '0'), lambda x: length(x))) AS INTEGER) AS consec,
    ({' + '.join(FLAGS)}) / 8.0::DOUBLE AS row_means,
    CASE WHEN {' + '.join(FLAGS)} > 0 THEN round(ln(({' + '.join(FLAGS)}) / 8.0::DOUBLE), 9) END AS log_row_means FROM wide"""))
def row_stats(spark, sf):
    out = E.row_statistics(wide(spark, sf, "ID", *FLAGS), FLAGS)
    return out.select("ID", "flag_sum", "consec", "row_means", F.round("log_row_means", 9).alias("log_row_means"))


@query("SCL-4 UDF-2", with_wide("""SELECT consec, count(*) AS n FROM (SELECT
    CAST(list_max(list_transform(string_split(X10 || X11 || X12 || X13, '0'), lambda x: length(x))) AS INTEGER) AS consec
    FROM wide) GROUP BY consec"""))
def longest_run(spark, sf):
    df = wide(spark, sf, "X10", "X11", "X12", "X13")
    return df.groupBy(C.longest_run(["X10", "X11", "X12", "X13"]).alias("consec")).agg(F.count(F.lit(1)).alias("n"))


@query("ENC-7 SCL-2", with_wide("""SELECT ID, CAST(dense_rank() OVER (ORDER BY X5 || X3) - 1 AS INTEGER) AS X5X3_code FROM wide"""))
def crossed_cat(spark, sf):
    df = E.crossed(wide(spark, sf, "ID", "X3", "X5"), "X5X3", ["X5", "X3"])
    return E.label_encode(df, ["X5X3"], "ID").select("ID", "X5X3_code")


PROBE_SQL = """probe AS (SELECT ID, 'list(y_value = ' || CASE WHEN ID % 50 = 1 THEN CAST(X22 AS VARCHAR) ELSE '' END || ', NA)' AS txt
    FROM wide WHERE tc = 0)"""


def probe_text(df: DataFrame) -> DataFrame:
    number = F.when(F.col("ID") % 50 == 1, F.col("X22").cast("string")).otherwise("")
    return df.filter("tc = 0").select("ID", F.concat(F.lit("list(y_value = "), number, F.lit(", NA)")).alias("txt"))


@query("SCL-1 SCL-7", with_wide(r"""SELECT ID, round(TRY_CAST(nullif(regexp_replace(regexp_replace(txt, '^(.*?),.*$', '\1'),
    'list\(|\)|y_value = |NA', '', 'g'), '') AS DOUBLE) / 3, 2) AS third FROM probe""", PROBE_SQL))
def regex_extract(spark, sf):
    df = probe_text(wide(spark, sf, "ID", "tc", "X22"))
    return df.select("ID", F.round(C.extract_number("txt") / 3, 2).alias("third"))


@query("ENC-11", with_wide("""SELECT ID, CAST(X22 AS DOUBLE) AS label FROM wide WHERE tc = 1
    UNION ALL SELECT ID, CAST(X22 AS DOUBLE) FROM wide WHERE tc = 0 AND ID % 50 = 1"""))
def label_augment(spark, sf):
    df = wide(spark, sf, "ID", "tc", "X22")
    train = df.filter("tc = 1").select("ID", F.col("X22").cast("double").alias("label"))
    return E.augment_labels(train, probe_text(df), "txt", "label")


@query("ORD-2 ORD-4 ORD-5", """SELECT o_custkey, n, mean_y FROM (SELECT o_custkey, count(*) AS n,
    round(avg(o_totalprice), 4) AS mean_y FROM orders GROUP BY o_custkey) ORDER BY n DESC, o_custkey DESC LIMIT 10""")
def top_groups(spark, sf):
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_y"))
    return per.orderBy(F.desc("n"), F.desc("o_custkey")).limit(10)
