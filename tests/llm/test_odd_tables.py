"""Each operator over documents on tables of nulls, repeated rows, a very long text and columns of clashing names, and on
an empty table."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from lexweave.llm import registry
from tests.llm.test_pipeline import DATA, needs_data

#: Names that operators use inside, or give to results of their own.
CLASHING = ["row_id", "id", "hash", "digest", "key", "n", "word", "words", "hit", "span", "spans", "kind", "start", "end", "group", "shard", "slot", "size", "law", "part", "seq", "position", "copies", "piece", "run", "n_words", "kept", "votes", "n_tokens", "ids", "n_symbols", "component_id", "quality", "toxic", "item_id", "sum", "count", "value", "_n", "entity", "term"]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
OPERATORS = ["op2_ngram_jaccard_join", "op3_bpe", "op4_sharding", "op5_quality_rules", "op6_token_store", "op8_pii", "op9_secret_scan", "op10_decontaminate", "op11_merkle", "op12_token_counts"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)] + ["password=abcdefgh1", "a@b.cd", "+49 123 456 7890", "\n"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    some = text(30)
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, some, "en", "s", 1), (5, some, None, "s", None), (5, some, None, "s", None), (6, text(40_000), "de", None, 7)]
    return odd + [(i, text(rng.randint(0, 60)), "en", "s", i) for i in range(7, 25)]


@pytest.fixture(scope="module")
def folders(spark, rows, tmp_path_factory):
    """Documents as they are, with clashing columns in front and behind, and none."""
    top = tmp_path_factory.mktemp("odd")
    plain = spark.createDataFrame(rows, COLUMNS)
    extra = [(F.col("doc_id") % 3).cast("int").alias(c) for c in CLASHING]
    tables = {"plain": plain, "clashing": plain.select(*extra[:20], "*", *extra[20:]), "empty": plain.where("false")}
    for name, df in tables.items():
        (top / name).mkdir()
        df.coalesce(2).write.parquet(str(top / name / "documents.parquet"))
        for t in ("labels", "benchmark"):
            os.symlink(f"{DATA}/{t}.parquet", top / name / f"{t}.parquet")
    return top


def _result(spark, name, folder):
    df = registry.QUERIES[name](spark, str(folder))
    return df.columns, sorted(map(repr, df.collect()))


@needs_data
@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_change_nothing(spark, folders, rows, name):
    columns, plain = _result(spark, name, folders / "plain")
    assert len(plain) == len(rows)
    assert (columns, plain) == _result(spark, name, folders / "clashing")


@needs_data
@pytest.mark.parametrize("name", OPERATORS)
def test_an_empty_table_gives_no_rows(spark, folders, name):
    columns, none = _result(spark, name, folders / "empty")
    assert none == [] and "doc_id" in columns
