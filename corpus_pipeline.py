"""Corpus pipeline: quality rules, near-dedup, benchmark decontamination, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and works on everything that its predecessor kept; all but the last return the columns
of ``documents``.  Documents that the quality rules reject go, one document of each group of near duplicates stays,
documents that hold a benchmark item go, secrets are replaced by a mark, and what is left is
packed into sequences of at most 1024 tokens (one row per piece, with its ids).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from colscope.llm import decontaminate, neardup, packing, quality, secrets
from colscope.llm.common import read_table
from colscope.session import settled

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates share 0.8 of their five-word shingles."""
    return neardup.drop_duplicates(docs, width=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, TOKENIZER, 1024, 2)


STAGES = [("quality rules", quality_rules), ("MinHash near-dedup", near_dedup),
          ("benchmark decontamination", benchmark_decontamination), ("secret scans", secret_scans), ("best-fit packing", best_fit_packing)]

#: The learned rules, the tokenizer and the latent space are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each one's result is written and read again; only the last one's table stays."""
    def whole() -> DataFrame:
        docs = read_table(spark, sf_dir, "documents")
        for _, stage in STAGES[:-1]:
            docs = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        return STAGES[-1][1](spark, docs, sf_dir)

    return settled(whole)
