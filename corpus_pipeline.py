"""The corpus pipeline: documents in, token sequences in training order out.

Every stage takes (spark, docs, sf_dir) and calls one operator of
``tessera.llm`` with its production parameters. All but the last return the
columns of ``docs``; ``run`` writes each result as Parquet to the shared
folder and rereads it for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import fm_index, mixing, near_duplicates, quality, token_shards
from tessera.llm.queries import MIX_WEIGHTS
from tessera.llm.tables import table
from tessera.session import cut_lineage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the log-likelihood ratio."""
    scored = quality.score_quality(docs, table(spark, sf_dir, "labels"))
    return scored.filter("quality.kept").select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate class (of several texts with that id, the first by digest);
    documents without an id are all kept."""
    classes = near_duplicates.classed(docs)
    first = classes.filter("id = class_id").groupBy("class", F.col("id").alias("doc_id")).agg(F.min("copy_of").alias("_copy_of"))
    marked = docs.withColumn("_copy_of", near_duplicates.digest("text"))
    stay = marked.join(first, ["doc_id", "_copy_of"], "left_semi").dropDuplicates(["doc_id", "_copy_of"]).drop("_copy_of")
    return stay.unionByName(docs.filter("doc_id is null")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the benchmark's windows cut out of their texts."""
    return fm_index.decontaminate(docs, table(spark, sf_dir, "benchmark"), length="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to the target weights of their sources, in global shuffle order."""
    return mixing.poisson_mix(docs, MIX_WEIGHTS).select("doc.*")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences at the slots of the training order."""
    return token_shards.training_order(docs).withColumnRenamed("key", "doc_id")


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mix_sources),
    ("token output", token_output),
]

#: Hashed scores, similarity joins and tokenizers have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules, near-duplicates, decontamination, mixing and token output over all documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
