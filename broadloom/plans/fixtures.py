"""Input tables, and a wide train/test table derived from them (Spark and SQL forms)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

FLAGS = ["X10", "X11", "X12", "X13", "X14", "X15", "X16", "X17"]
LEVELS = ["X0", "X1", "X2", "X3", "X4", "X5"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _any(cond):
    return F.max(cond.cast("int"))


def wide(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """One row per order: target, categorical levels, 0/1 flags. Only the joins the asked columns need."""
    want = set(cols)
    everything = not want
    if want & {"X19", "X20"}:
        want |= {"X10", "X11"}
    if "X23" in want:
        want.add("X22")
    if want & {"y_lin", "y_out"}:
        want |= {"X14", "X15", "X22", "y_lin"}
    need = lambda *c: everything or bool(want & set(c))

    ident = F.col("o_orderkey")
    df = table(spark, sf, "orders").select(
        ident.alias("ID"), F.col("o_totalprice").alias("y"),
        (ident % 2 == 0).cast("int").alias("tc"), "o_custkey",
        F.col("o_orderpriority").alias("X1"), F.col("o_orderstatus").alias("X2"),
        F.when(ident % 200 == 0, "only_train").when((ident % 2 == 1) & (ident % 199 == 0), "only_test")
         .otherwise(F.col("o_orderpriority")).alias("X4"),
        F.when(ident % 13 == 0, F.lit(None)).otherwise(F.concat(F.lit("g"), (ident % 7).cast("string"))).alias("X6"),
        F.lit(1).alias("X18"), (ident % 1499 == 0).cast("int").alias("X21"))

    if need(*FLAGS, "X22"):
        lines = table(spark, sf, "lineitem")
        aggs = {
            "X10": _any(F.col("l_returnflag") == "R"), "X11": _any(F.col("l_returnflag") == "A"),
            "X12": _any(F.col("l_returnflag") == "N"), "X13": _any(F.col("l_linestatus") == "O"),
            "X14": _any(F.col("l_quantity") >= 45), "X15": _any(F.col("l_discount") >= 0.09),
            "X16": _any(F.col("l_tax") >= 0.08), "X22": F.count(F.lit(1)).cast("int"),
        }
        if need("X17"):
            part = table(spark, sf, "part").select("p_partkey", "p_size")
            lines = lines.join(part, lines.l_partkey == part.p_partkey)
            aggs["X17"] = _any(F.col("p_size") <= 5)
        picked = [c for c in aggs if need(c)]
        per_order = lines.groupBy(F.col("l_orderkey").alias("ID")).agg(*[aggs[c].alias(c) for c in picked])
        df = df.join(per_order, "ID", "left").fillna(0, picked)

    if need("X0", "X3", "X5"):
        cust = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("X0"), "c_nationkey")
        if need("X3", "X5"):
            nation = table(spark, sf, "nation").select(
                F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("X3"), "n_regionkey")
            region = table(spark, sf, "region").select(
                F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("X5"))
            cust = cust.join(nation.join(region, "n_regionkey"), "c_nationkey")
        df = df.join(cust, df.o_custkey == cust.c_custkey)

    if need("X19", "X20"):
        df = df.withColumns({"X19": F.col("X10"),
                             "X20": F.when(F.col("ID") % 97 == 0, 1 - F.col("X11")).otherwise(F.col("X11"))})
    if need("X23"):
        df = df.withColumn("X23", F.when(F.col("ID") % 11 != 0, F.col("X22").cast("double")))
    if need("y_lin", "y_out"):
        noise = ((F.col("ID") * 7919) % 101 - 50) / F.lit(10.0)
        df = df.withColumn("y_lin", 100 + 25 * F.col("X14") - 8 * F.col("X15") + 5 * F.col("X22") + noise)
        df = df.withColumn("y_out", F.col("y_lin") + F.when(F.col("ID") % 41 == 0, 500.0).otherwise(0.0))
    order = ["ID", "y", "tc", "X0", "X1", "X2", "X3", "X4", "X5", "X6", *FLAGS,
             "X18", "X19", "X20", "X21", "X22", "X23", "y_lin", "y_out"]
    return df.select(*(order if everything else cols))


WIDE_SQL = """wide AS (
  SELECT w.*, X10 AS X19, CASE WHEN ID % 97 = 0 THEN 1 - X11 ELSE X11 END AS X20,
         CASE WHEN ID % 11 <> 0 THEN CAST(X22 AS DOUBLE) END AS X23,
         100 + 25 * X14 - 8 * X15 + 5 * X22 + ((ID * 7919) % 101 - 50) / 10.0::DOUBLE AS y_lin,
         100 + 25 * X14 - 8 * X15 + 5 * X22 + ((ID * 7919) % 101 - 50) / 10.0::DOUBLE
           + CASE WHEN ID % 41 = 0 THEN 500.0::DOUBLE ELSE 0.0::DOUBLE END AS y_out
  FROM (SELECT o_orderkey AS ID, o_totalprice AS y, CAST(o_orderkey % 2 = 0 AS INTEGER) AS tc,
      c_mktsegment AS X0, o_orderpriority AS X1, o_orderstatus AS X2, n_name AS X3,
      CASE WHEN o_orderkey % 200 = 0 THEN 'only_train'
           WHEN o_orderkey % 2 = 1 AND o_orderkey % 199 = 0 THEN 'only_test' ELSE o_orderpriority END AS X4,
      r_name AS X5, CASE WHEN o_orderkey % 13 <> 0 THEN 'g' || CAST(o_orderkey % 7 AS VARCHAR) END AS X6,
      coalesce(X10, 0) AS X10, coalesce(X11, 0) AS X11, coalesce(X12, 0) AS X12, coalesce(X13, 0) AS X13,
      coalesce(X14, 0) AS X14, coalesce(X15, 0) AS X15, coalesce(X16, 0) AS X16, coalesce(X17, 0) AS X17,
      1 AS X18, CAST(o_orderkey % 1499 = 0 AS INTEGER) AS X21, coalesce(X22, 0) AS X22
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN (SELECT l_orderkey,
        max(CAST(l_returnflag = 'R' AS INTEGER)) AS X10, max(CAST(l_returnflag = 'A' AS INTEGER)) AS X11,
        max(CAST(l_returnflag = 'N' AS INTEGER)) AS X12, max(CAST(l_linestatus = 'O' AS INTEGER)) AS X13,
        max(CAST(l_quantity >= 45 AS INTEGER)) AS X14, max(CAST(l_discount >= 0.09::DOUBLE AS INTEGER)) AS X15,
        max(CAST(l_tax >= 0.08::DOUBLE AS INTEGER)) AS X16, max(CAST(p_size <= 5 AS INTEGER)) AS X17,
        CAST(count(*) AS INTEGER) AS X22
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey) ON l_orderkey = o_orderkey) w)"""


def with_wide(sql: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([WIDE_SQL, *ctes]) + "\n" + sql


def dup_source(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_returnflag", "l_linestatus", "l_linenumber", F.col("l_quantity").cast("int").alias("qty"),
        F.col("l_extendedprice").alias("y"))
