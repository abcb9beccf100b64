"""Each registered query against its SQL, and the rest against having rows, on the smallest tables."""

from __future__ import annotations

import os
import random
import re

import numpy as np
import pytest

from lexweave.operators import quotes, retrieval
from lexweave.plans import registry
from tests.oracle import connect, same

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    return connect(DATA)


@needs_data
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, db, name):
    same(registry.QUERIES[name](spark, DATA), db, registry.ORACLE_SQL[name])


@needs_data
@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLE_SQL.keys()))
def test_has_rows(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_clause_of_quotes_equals_brute_force(spark, tmp_path):
    rng = random.Random(1)
    line = lambda n: " ".join(f"w{rng.randrange(50)}" for _ in range(n))
    texts = ["\n".join(line(rng.choice((1, 5, 40, 199, 1500))) for _ in range(rng.randrange(1, 30))) for _ in range(12)]
    texts += ["a\nb\n\td\n" + line(590) + "\n! c\n\u2013 e f\n1.1 g", "\n\n\n", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    wanted = {}
    for doc, text in enumerate(texts):
        tokens, asked = [], []
        for i, x in enumerate((text or "").split("\n")):
            words = x.split(" ")
            if i % 6 == 0:
                x = f"{i // 6 % 90 + 1}. " + " ".join(words[:3])
            elif i % 3 == 0:
                x = f"{i // 6 % 90 + 1}.{i % 6 // 3 + 1} {x}"
            if text is not None and x.strip():
                if i % 3 == 2:
                    asked.append((i, len(tokens)))
                tokens += [(t, k == 0) for k, t in enumerate(x.split()) if t.strip(quotes.STRIP)]
        for i, at in asked:
            wanted[doc, i] = None
            for t, first in tokens[max(0, at - 599) : at + 1][::-1]:
                if first and re.fullmatch(r"\d{1,2}\.", t):
                    break
                if first and re.fullmatch(r"\d{1,2}(\.\d{1,3}){1,3}", t.strip(quotes.STRIP)):
                    wanted[doc, i] = t.strip(quotes.STRIP)
                    break
    found = registry.QUERIES["clause_of_quotes"](spark, str(tmp_path)).collect()
    assert {(r.document, r.quote): r.clause for r in found} == wanted and len(found) == len(wanted)
    assert len(set(wanted.values())) > 3


def test_review_chain_of_two_documents(spark, tmp_path):
    first = "Delivery terms of the goods\nThe goods come in ten days after the order was placed.\nPenalty of ten percent of the price is due when payments come late."
    docs = [(1, first), (2, "Some other words that stand here\nNothing in this text concerns the rules at all."), (3, None), (4, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    items = [(0, "Penalty clause for late payments"), (1, "Unrelated zebra question"), (4, "Penalty for late payments again")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = registry.QUERIES["review_chain"](spark, str(tmp_path)).collect()
    assert [r.document for r in found] == [1]
    # both rules quote one sentence, so their findings are one
    assert (found[0].critical, found[0].warning, found[0].light) == (1, 0, "RED") and found[0].score > 0
    assert found[0].verified == 1


def test_review_chain_ranks_as_a_slow_fusion(spark):
    """Chunks under keys of text, ranked by both ways and fused, against loops over all pairs."""
    rng = random.Random(5)
    words = [f"слово{i}" for i in range(40)]
    items = [(i, " ".join(rng.sample(words, 4))) for i in range(6)]
    chunks = [(f"{i // 3}/{i % 3}", " ".join(rng.choices(words, k=rng.choice([0, 5, 9])))) for i in range(30)]
    asked = spark.createDataFrame(items, "item_id long, text string")
    told = spark.createDataFrame(chunks, "key string, text string")
    lexical = retrieval.lexical_ranks(asked, told, "item_id", "key", 12)
    vectors = retrieval.vector_ranks(retrieval.hash_embeddings(asked, "item_id", "text"), retrieval.hash_embeddings(told, "key", "text"), "item_id", "key", 12)
    found = {(r.item_id, r.key): (round(r.score, 9), r.fts_hit) for r in retrieval.fused(vectors, lexical, "item_id", "key", 12).collect()}

    wanted = {}
    for item, text in items:
        stems = {w[:6] for w in text.split()}
        hits = sorted((-n, k) for k, t in chunks if (n := sum(w[:6] in stems for w in t.split())))[:12]
        q = retrieval.hash_vector(text).astype(float)
        near = []
        for k, t in chunks:
            v = retrieval.hash_vector(t).astype(float)
            if t and (gap := 1 - q @ v / np.linalg.norm(q) / np.linalg.norm(v)) <= retrieval.CUTOFF:
                near.append((gap, k))
        scores = {}
        for ranked in (hits, sorted(near)[:12]):
            for place, (_, k) in enumerate(ranked, 1):
                scores[k] = scores.get(k, 0.0) + 1 / (60 + place)
        best = sorted(scores, key=lambda k: (-scores[k], k))[:12]
        wanted |= {(item, k): (round(scores[k], 9), k in {k for _, k in hits}) for k in best}
    assert found == wanted
    assert len(wanted) > 30
