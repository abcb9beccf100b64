"""Queries of the training-data operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexweave.llm import bpe_lexicon, decontaminate, html_extract, language_id, merkle, ngram_join, pii, quality_rules, secret_scan, sharding, subvectors, token_counts, token_store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": language_id.op1_language_id,
    "op2_ngram_jaccard_join": ngram_join.op2_ngram_jaccard_join,
    "op3_bpe": bpe_lexicon.op3_bpe,
    "op4_sharding": sharding.op4_sharding,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_token_store": token_store.op6_token_store,
    "op7_html_extract": html_extract.op7_html_extract,
    "op8_pii": pii.op8_pii,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_merkle": merkle.op11_merkle,
    "op12_token_counts": token_counts.op12_token_counts,
    "op13_centroids": subvectors.op13_centroids,
}

ORACLE_SQL: dict[str, str] = {"op10_decontaminate": decontaminate.ORACLE_SQL, "op11_merkle": merkle.ORACLE_SQL, "op13_centroids": subvectors.ORACLE_SQL}
