"""Registered queries of the subpackage and their DuckDB twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.llm import chat, decontaminate, licenses, merkle, mixing, neardup, packing, quality, secrets, sharding, sql, token_counts, toxicity, trie
from colscope.llm.common import read_table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return packing.piece_digests(packing.pack_documents(read_table(spark, sf_dir, "documents"), TOKENIZER, 1024, 2))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix-target examples of all conversations and of conversation -7, read back."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.digest_examples(chat.expand_prefix_targets(turns.unionByName(extra)))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards by jump consistent hashing of doc_id."""
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"), 40)


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans and inferred format spans of all documents."""
    return secrets.span_digests(secrets.find_secrets(read_table(spark, sf_dir, "documents")))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    counts = token_counts.count_tokens(read_table(spark, sf_dir, "documents"), TOKENIZER)
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of all documents and the verdict of the learned decision list."""
    judged = quality.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences in all documents, one row per document and licence."""
    return licenses.find_licenses(read_table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold, one row per document and item."""
    found = decontaminate.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.drop("tag")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents linked by 4-word shingles with a similarity of 0.8 or more."""
    found = neardup.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations, rebuilt with the first turns of their family's first one."""
    conv = F.col("conv")
    return trie.prefix_trie(read_table(spark, sf_dir, "conversations"), F.crc32(conv.cast("string")) % 4, conv - conv % 20)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, proofs and folded roots of all documents, a third of them tampered with."""
    return merkle.manifest(read_table(spark, sf_dir, "documents"), merkle.lowered_leaf(3), paths=False)


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents takes of each, sources weighing 5, 2, 1 in turn."""
    plan = mixing.plan_mix(read_table(spark, sf_dir, "documents"), (5, 2, 1), 3)
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies")


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_chat_formatting, op3_sharding, op4_secret_scans, op5_token_counts,
                                  op6_quality_rules, op7_license_scans, op8_benchmark_decontamination,
                                  op9_minhash_near_dedup, op10_toxicity, op11_conversation_prefix_trie, op12_merkle_manifest, op13_source_mixing)}

ORACLE = {"op2_chat_formatting": sql.OP2, "op3_sharding": sql.OP3, "op7_license_scans": sql.OP7,
          "op11_conversation_prefix_trie": sql.OP11, "op12_merkle_manifest": sql.OP12, "op13_source_mixing": sql.OP13}
