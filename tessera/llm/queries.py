"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import (chat, fm_index, hidden_markov, importance, mixing, near_duplicates, pii, quality, sharding, spelling, suffix_dedup,
                         token_counts, token_shards)
from tessera.llm.tables import table

# Production parameters: weights of the mix by source (others get 1) and the number of shards.
MIX_WEIGHTS = {"src0": 2.0, "src1": 2.0, "src2": 1.5, "src3": 0.5}
SHARDS = 16


def conversation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` and conversation -1 as reply chains: each row answers the one before it by turn."""
    tag = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tag).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.unionByName(extra).withColumn("tree", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text"))
    rows = rows.withColumn("node", place.cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text",
                       F.lit(0.0).alias("score"))


def op1_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in all documents by backward search in FM-indexes of document shards."""
    out = fm_index.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("doc.doc_id", "hit.n_words", "hit.n_hit", F.size("hit.items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("hit.items", ","), 256).alias("items_sha256"),
                      (F.col("hit.n_hit") > 0).alias("contaminated"), F.size("hit.spans").cast("long").alias("n_spans"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as reply trees, formatted, and read back from the formatted text."""
    out = chat.format_trees(conversation_nodes(spark, sf_dir))
    turns = chat.parse_turns(F.col("formatted"))
    lines = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.masked_text(F.col("formatted"), F.col("loss_spans"))
    return out.select(F.col("tree").try_cast("long").alias("conv_id"), F.size(turns).cast("long").alias("n_turns"),
                      F.sha2(lines, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"),
                      F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-byte strings that start in an earlier document."""
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op4_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents replicated to the target mixture, one row per copy, in global shuffle order."""
    docs = table(spark, sf_dir, "documents")
    out = mixing.poisson_mix(docs, MIX_WEIGHTS)
    return out.select("doc.doc_id", "doc.source", "doc.text", "copy", "rate", "order_key")


def op5_llr_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the log-likelihood-ratio verdict of every document."""
    out = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return out.select("doc.doc_id", "quality.*")


def op6_stratified_interleaving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards that each match the mixture of sources; shard row counts differ by at most one."""
    docs = table(spark, sf_dir, "documents")
    raw = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.col("source").alias("stratum"), (F.octet_length(raw) + 1).cast("long").alias("size"),
                       F.crc32(raw.cast("binary")).alias("text_crc32"))
    out = sharding.stratified_shards(rows, SHARDS, key="doc_id")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), F.col("stratum").alias("source"), "position")


def op7_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: base patterns, and tokens of patterns induced from them."""
    out = pii.find_personal_data(table(spark, sf_dir, "documents"), keep=["doc_id"])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{pii.KINDS[k]}")
    return out.select("doc.doc_id", *[count(k) for k in range(4)], F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"),
                      pii.spans_text(F.col("spans")).alias("spans"))


def op8_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document: ProbMinHash bands, verified on whole texts."""
    out = near_duplicates.near_duplicate_classes(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "class_id")


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as fixed-stride token sequences at the slots of a keyed permutation."""
    return token_shards.training_order(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def op10_transducer_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole document, by the compiled transducer of the vocabulary."""
    out = token_counts.count_tokens(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > token_counts.TOKEN_LIMIT).alias("over_limit"))


def op11_trie_pair_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of all words of all documents, from pairs of trie nodes."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighed by n-gram gains towards the benchmark's distribution; a quarter is drawn and ranked."""
    out = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("doc.doc_id", "n_features", "weight", "score", "rank")


def op13_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-frequency and hidden-Markov-model log probabilities of all documents."""
    out = hidden_markov.score_texts(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc.doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {f.__name__: f for f in (
    op1_fm_index_decontamination, op2_chat_formatting, op3_suffix_array_dedup, op4_poisson_mixing, op5_llr_quality, op6_stratified_interleaving,
    op7_bootstrapped_pii, op8_probminhash, op9_training_order, op10_transducer_token_counts, op11_trie_pair_spelling,
    op12_importance_resampling, op13_hidden_markov)}
