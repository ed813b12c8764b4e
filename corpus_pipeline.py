"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Toxic documents go, then poor ones, then all but one of each group of near copies; the rest is mixed to
target weights (once each, so that documents stay single) and packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import common, jaccard_join, mixing, packing, quality, toxicity

#: Share of the remaining tokens that the mixture takes.
MIX_SHARE = 0.9


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean_documents(docs, common.read(spark, sf_dir, "labels"))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs, common.read(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: of its smallest id, the one with the smallest text.

    All rows of an id are one document, so an id with several texts links their components.  Rows without an
    id are documents by their text; they count as ids above 2**62, so that rows with an id stay before them.
    """
    by_text = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    name = "_document"
    while name in {c.lower() for c in docs.columns}:
        name = "_" + name
    columns = [F.col(f"`{c}`") for c in docs.columns]
    own = docs.withColumn(name, F.coalesce(F.col("doc_id").cast("long"), by_text))
    found = jaccard_join.jaccard_components(own.select(F.col(name).alias("doc_id"), "text"))
    found = common.checkpoint(found.groupBy("doc_id", "component_id").agg(F.count("*").alias("n")))
    ids = common.checkpoint(found.groupBy("doc_id").agg(F.min("component_id").alias("src"), F.max("component_id").alias("last"), F.sum("n").alias("n")))
    labels = common.components(found.join(ids.filter("src <> last").drop("n"), "doc_id").select("src", F.col("component_id").alias("dst")))
    grouped = ids.join(labels, ids["src"] == labels["id"], "left").select("doc_id", "n", F.coalesce("component", "src").alias("component"))
    heads = grouped.groupBy("component").agg(F.min("doc_id").alias("head"))
    gone = common.checkpoint(grouped.join(heads, "component").filter("doc_id <> head").select(F.col("doc_id").alias(name)))
    many = common.checkpoint(ids.filter("n > 1").select(F.col("doc_id").alias(name)).join(gone, name, "left_anti"))
    small = lambda x, n: F.broadcast(x) if n <= jaccard_join.BROADCAST_IDS else x
    kept, n_many = own.join(small(gone, gone.count()), name, "left_anti"), many.count()
    once = kept.join(small(many, n_many), name, "left_anti").select(columns)
    if not n_many:
        return once
    first = F.min_by(F.struct(*columns), F.struct(F.col("text").isNull(), "text")).alias("row")
    return once.union(kept.join(small(many, n_many), name, "left_semi").groupBy(name).agg(first).select("row.*"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, budget_share=MIX_SHARE, epochs=1).select([F.col(f"`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", toxic), ("quality", good), ("jaccard_join", deduplicate), ("mixing", mixture), ("packing", packed)]

#: None: SQL can express neither the fitted models nor the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents, each through a Parquet table in the shared folder that the next one's replaces."""
    docs = common.read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), instead_of=docs)
    return docs
