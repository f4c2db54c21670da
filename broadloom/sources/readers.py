"""Table readers: CSV, Parquet, nested JSON, a folder of prediction files, key skeletons, grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Header CSV with a declared schema; nothing is inferred, so the file is read once."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, records: str, lines: bool = False) -> DataFrame:
    """One row per record of the nested list ``records``, its fields as columns. A file is one document, or with ``lines``
    one document per line, which can be read in splits."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path) \
        .select(F.explode(records).alias("s")).select("s.*")


def flatten_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Parse a JSON string column and lift its fields to the top level."""
    rest = [c for c in df.columns if c != column]
    return df.withColumn("__j", F.from_json(column, schema)).select(*rest, "__j.*")


def read_predictions(spark: SparkSession, path: str, key: str = "ID", value: str = "pred") -> DataFrame:
    """Folder of ``<model>.csv`` tables as long rows (key, model, pred); the file stem names the model."""
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)\.csv(?:/[^/]*)?$", 1)
    return spark.read.schema(f"{key} bigint, {value} double").option("header", True).csv(f"{path}/*.csv") \
        .select(key, stem.alias("model"), value)


def pivot_predictions(long: DataFrame, models: list[str], key: str = "ID", value: str = "pred") -> DataFrame:
    """One column per model. The model list is given, so no extra job looks for it."""
    return long.groupBy(key).pivot("model", models).agg(F.first(value))


def key_skeleton(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct()


def param_grid(df: DataFrame, grid: dict[str, list]) -> DataFrame:
    """Every row of ``df`` once per combination of the literal parameter lists (map-only)."""
    return reduce(lambda d, kv: d.withColumn(kv[0], F.explode(F.array(*[F.lit(v) for v in kv[1]]))),
                  grid.items(), df)
