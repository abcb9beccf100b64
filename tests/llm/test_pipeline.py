"""The pipeline's stages one after another, and the registered queries on the smallest tables."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline
from lexweave.llm import decontaminate, registry
from lexweave.llm.common import stage, table
from tests.oracle import connect, same

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@needs_data
def test_stages_take_effect(spark):
    docs = table(spark, DATA, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, DATA), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] >= counts[3] == counts[4] > 0
    assert decontaminate.find_overlaps(docs, table(spark, DATA, "benchmark")).where("size(hit) > 0").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.count() == counts[-1] and set(last.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


@needs_data
def test_stages_run_on_an_empty_table(spark):
    docs = stage(table(spark, DATA, "documents").where("false"), "empty")
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, DATA), name)
        assert docs.count() == 0


@needs_data
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, name):
    same(registry.QUERIES[name](spark, DATA), connect(DATA), registry.ORACLE_SQL[name])


@needs_data
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_a_row_for_each_input_row(spark, name):
    rows = registry.QUERIES[name](spark, DATA).count()
    documents, pages, vectors = (table(spark, DATA, t).count() for t in ("documents", "pages", "embeddings"))
    assert rows == {"op1_language_id": documents + pages, "op7_html_extract": pages, "op13_centroids": vectors}.get(name, documents)


@needs_data
def test_masking_and_an_empty_benchmark_drop_nothing(spark, tmp_path):
    clean = "eight words that hold no secret at all"
    rows = [(1, None), (2, ""), (3, clean), (3, clean), (4, f"{clean} password=abcdefgh1")]
    docs = stage(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "CAST(length(text) AS long) AS n_chars"), "odd")
    table(spark, DATA, "benchmark").where("false").write.parquet(str(tmp_path / "benchmark.parquet"))
    steps = dict(corpus_pipeline.STAGES)
    key = lambda r: (r[0], r[1] or "")
    kept = steps["decontaminated"](spark, docs, str(tmp_path))
    assert sorted(map(tuple, kept.select("doc_id", "text").collect()), key=key) == sorted(rows, key=key)
    masked = sorted(map(tuple, steps["secrets"](spark, docs, str(tmp_path)).select("doc_id", "text").collect()), key=key)
    assert masked[:4] == sorted(rows[:4], key=key)
    assert masked[4][0] == 4 and masked[4][1].startswith(clean) and "abcdefgh1" not in masked[4][1]
