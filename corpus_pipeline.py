"""Corpus pipeline: quality rules, near duplicates, decontamination, secrets, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexweave.llm import bpe_lexicon, decontaminate, ngram_join, quality_rules, secret_scan
from lexweave.llm.common import stage, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject, those without text or of fewer than ten words among them. Equal
    texts have one verdict; an empty table stays empty."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by five-word shingles at a similarity of 0.8: the one with the smallest
    doc_id, of repeated rows the first. Documents without words, or without text, all stay."""
    return ngram_join.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of the benchmark. A null text holds none; nor does any text if the benchmark
    is empty."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; every document stays, repeated rows and those without text too."""
    return secret_scan.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text, one row for each document; a null text has no tokens."""
    return bpe_lexicon.encode(docs, digests=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("secrets", secrets), ("tokens", tokens)]

#: Expectation-maximisation, signature joins and byte-pair merges are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
