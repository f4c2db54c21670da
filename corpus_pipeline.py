"""From raw documents to packed sequences: toxic documents go, one of each group of near copies stays, documents that
hold benchmark passages go, and the rest is packed into training sequences.

Each stage takes (spark, docs, sf_dir), where ``docs`` has the columns of ``documents`` and whatever others come with
them, and returns the rows that stay; the last returns pieces of sequences. ``run`` writes each stage's result to the
shared folder and reads it again as the next one's input, so that no stage repeats another's work after a lost executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from broadloom.llm import decontaminate, near_dup, packing, queries, toxicity
from broadloom.llm.common import table
from broadloom.llm.registry import text_query
from broadloom.session import durable


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxic threshold; NULL and empty texts score as the model's bias and stay with it.

    The model learns from labelled rows of ``docs``; without any, the score is the bias of an even start and nothing goes
    unless that reaches the threshold. An empty table stays empty.
    """
    name = "_toxicity"
    while name in docs.columns:
        name += "_"
    scored = toxicity.score_toxicity(docs, queries.toxicity_model(spark, docs, sf_dir), name=name)
    return scored.filter(F.col(f"`{name}`") < queries.TOXIC_FROM).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies. Of rows that repeat an id one stays; texts without words
    are nobody's copies, and rows with a NULL id stay all."""
    groups = durable(near_dup.group_near_duplicates(docs))
    ids = groups.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept"))
    # Those that go are far fewer than those that stay: a short list seldom makes the texts move.
    few = durable(ids.filter("not kept or n > 1"))
    out = docs.filter("doc_id is not null").join(few.filter("not kept").select("doc_id"), "doc_id", "left_anti")
    if not few.filter("kept").isEmpty():
        out = out.dropDuplicates(["doc_id"])
    return out.unionByName(docs.filter("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which fewer than one word in twenty lies in windows of benchmark items."""
    marked = decontaminate.mark_contaminated(docs, table(spark, sf_dir, "benchmark"))
    return marked.filter("not contaminated").select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 ids, with their ids; NULL and empty texts are one closing id."""
    return packing.pack_documents(docs, f"{queries.TOKENIZERS}/byte_bpe_50k.json", with_ids=True)


STAGES = [("toxicity", drop_toxic), ("near_dup", drop_near_copies), ("decontamination", drop_contaminated), ("packing", pack)]

#: SQL expresses neither the fitted model nor the packing; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs


@text_query(ORACLE_SQL)
def pipeline(spark, sf):
    return run(spark, sf)
