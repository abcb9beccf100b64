"""Merkle manifest, token counts and centroid clustering against brute force, on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexweave.llm import common, merkle, subvectors, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOCS)


# --- Merkle manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def proofs(leaves):
    """The root of a list, and for each of its members the siblings left and right on each level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for k, i in enumerate(at):
            run, slot = runs[i // 8], i % 8
            paths[k].append((run[:slot], run[slot + 1 :]))
            at[k] = i // 8
        level = [digest(*run) for run in runs]
    return level[0], paths


def brute_manifest(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    order = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    grown = {}
    for lang in order:
        members = sorted(trees[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        grown[lang] = (members, *proofs([leaf_of(*r) for r in members]))
    root, tops = proofs([grown[lang][1] for lang in order])
    out = []
    for lang, top in zip(order, tops, strict=True):
        members, subroot, paths = grown[lang]
        for row, path in zip(members, paths, strict=True):
            text = row[1]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and text is not None:
                text = text.translate(str.maketrans(merkle.UPPER, merkle.LOWER))
            folded = leaf_of(row[0], text, *row[2:])
            for left, right in path + top:
                folded = digest(*left, folded, *right)
            siblings = digest(*[x for left, right in path + top for x in left + right])
            out.append((row[0], leaf_of(*row), subroot, root, siblings, folded, folded == root))
    return sorted(out, key=str)


def queried(docs):
    tampered = F.crc32(docs["doc_id"].cast("string")) % 3 == 0
    found = merkle.manifest(docs, tampered, F.translate(docs["text"], merkle.UPPER, merkle.LOWER))
    return sorted(map(tuple, found.collect()), key=str)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, "de": 9}, {"en": 73, "de": 64, None: 1, "": 2, "é": 3}, {f"l{i:02}": 1 + i % 3 for i in range(19)}])
def test_manifest_equals_brute_force(spark, sizes):
    rng = random.Random(3)
    ids = iter(rng.sample(range(10_000), sum(sizes.values())))
    rows = [(next(ids), rng.choice(("Text A", "lower only", "ÄÖ Übung", "", None)), lang, rng.choice(("s", None, "")), rng.choice((1, None))) for lang, n in sizes.items() for _ in range(n)]
    rng.shuffle(rows)
    found = queried(docs_of(spark, rows).repartition(3))
    assert found == brute_manifest(rows)
    changed = {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] in ("Text A", "ÄÖ Übung")}
    # lower-casing Ü alone would change nothing, but the text also has other capitals only outside A-Z
    assert {r[0] for r in found if not r[6]} == {i for i in changed if dict((r[0], r[1]) for r in rows)[i] == "Text A"}


def test_manifest_of_odd_tables(spark):
    long_text = "Word " * 40_000
    rows = [(None, None, None, None, None), (None, "A", None, None, None), (5, "same", "en", "s", 4), (5, "same", "en", "s", 4), (5, "Other", "en", "s", 5), (7, long_text, "en", "s", len(long_text))]
    rows += [(5, "same", "en", "s", 4)] * 30
    docs = docs_of(spark, rows).select("*", *[F.lit(1).alias(c) for c in ("tree", "idx", "digest", "run", "salt", "leaf", "rest")])
    assert queried(docs) == brute_manifest(rows)
    assert queried(docs_of(spark, [])) == []
    untouched = merkle.manifest(docs).collect()
    assert len(untouched) == len(rows) and all(r.verified for r in untouched)


def test_manifest_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(merkle, "MAX_BROADCAST", 0)
    rows = [(i, f"t{i % 7}", f"l{i % 2}", "s", 1) for i in range(100)]
    assert queried(docs_of(spark, rows)) == brute_manifest(rows)


# --- token counts


def library_counts(texts):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=token_counts.default_model())
    return [len(model.encode(t or "")) for t in texts]


def odd_texts():
    rng = random.Random(9)
    alphabet = ["a", "the", " ", "  ", "   ", "\n", "\n\n", "\t", "\r\n", "▁", "▁▁", "\x1f", "<s>", "</s>", "<unk>", "<0x0A>", "é", "ﬁ", "日本語", "🙂", "é", "\x00", ".", "1234", "ing", " ", "​"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(600)]
    return texts + [None, "", " ", "\n", "a", " a", "a ", "x" * 5000, "ab " * 3000, "日本" * 2000, "a\n b", "  lead", "one two\nthree four"]


@pytest.mark.parametrize("frequent", [0, 20, 5000])
def test_counts_equal_the_library(spark, monkeypatch, frequent):
    monkeypatch.setattr(token_counts, "SLICE_BYTES", 3000)
    texts = odd_texts()
    docs = docs_of(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    found = {r.doc_id: r for r in token_counts.count_tokens(docs, limit=1000, frequent=frequent).collect()}
    for i, (text, n) in enumerate(zip(texts, library_counts(texts), strict=True)):
        assert (found[i].n_bytes, found[i].n_tokens, found[i].over_limit) == (len((text or "").encode()), n, n > 1000), repr(text)


def test_counts_of_odd_tables(spark):
    rows = [(None, None, None, None, None), (1, "two words", "en", "s", 9), (1, "two words", "en", "s", 9)]
    docs = docs_of(spark, rows).select("*", *[F.lit(7).alias(c) for c in ("n_tokens", "n_bytes", "parts", "counts")])
    found = token_counts.count_tokens(docs)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, found.collect()), key=str) == [(1, 9, 2, False), (1, 9, 2, False), (None, 0, 0, False)]
    assert token_counts.count_tokens(docs_of(spark, [])).count() == 0


def test_a_long_text_is_cut_alone():
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4], "text": ["a" * 10, "b" * (token_counts.SLICE_BYTES + 5), "c", "d"]})
    assert [x.num_rows for x in token_counts.slices(batch)] == [1, 1, 2]


def test_summaries_keep_what_is_frequent():
    rng, whole, merged = random.Random(4), token_counts.Counter(), token_counts.Counter()
    for _ in range(40):
        part = token_counts.Counter(rng.choice("abc") if rng.random() < 0.5 else f"w{rng.randrange(5000)}" for _ in range(2000))
        whole.update(part)
        token_counts.shrink(part, 50)
        merged.update(part)
        token_counts.shrink(merged, 50)
    total = sum(whole.values())
    assert len(merged) <= 50 and all(w in merged for w, n in whole.items() if n > total / 50)
    assert all(n <= whole[w] for w, n in merged.items())


def test_frequent_parts_are_those_of_the_corpus(spark):
    docs = docs_of(spark, [(i, "common words here " * 5 + f"rare{i}", "en", "s", 1) for i in range(50)])
    texts = docs.select("text")
    assert set(token_counts.frequent_parts(texts, token_counts.default_model(), 3)) == {"▁common", "▁words", "▁here"}


# --- centroid clustering


def brute_clusters(rows, clusters=8, rounds=10):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in first[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for k in range(len(centroids)):
            own = [v for (_, v), c in zip(kept, of, strict=True) if c == k]
            if own:
                centroids[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = {k: sum(d for _, d, c in found if c == k) for k in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, d, c in found], key=str)


def vectors(n, seed=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (5, 64))
    return [(i, (centres[i % 5] + rng.normal(0, 0.2, 64)).astype(np.float32).tolist()) for i in range(n)]


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


@pytest.mark.parametrize("chunk", [7, 16_384])
def test_clusters_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(subvectors, "CHUNK", chunk)
    monkeypatch.setattr("lexweave.llm.common.BATCH_ROWS", 5)
    rows = vectors(150)
    rows += [(200 + i, rows[3][1]) for i in range(60)]
    bad = [(300, None), (301, []), (302, rows[0][1][:63]), (303, rows[0][1] + [0.0]), (304, [None] + rows[0][1][1:]), (305, [float("nan")] + rows[0][1][1:]), (306, [float("inf")] + rows[0][1][1:])]
    found = subvectors.cluster_vectors(frame_of(spark, rows + bad + [(None, rows[9][1])]).repartition(3))
    assert sorted(map(tuple, found.collect()), key=str) == brute_clusters(rows + bad + [(None, rows[9][1])])


def test_clusters_of_odd_tables(spark):
    assert subvectors.cluster_vectors(frame_of(spark, [])).collect() == []
    three = vectors(3)
    assert sorted(map(tuple, subvectors.cluster_vectors(frame_of(spark, three)).collect()), key=str) == brute_clusters(three)
    same = [(i, [0.5] * 64) for i in range(20)]  # ties: all go to the first centroid, the others stay
    found = subvectors.cluster_vectors(frame_of(spark, same).withColumn("cluster", F.lit(4)).withColumn("n", F.lit(4)))
    assert sorted(map(tuple, found.collect()), key=str) == brute_clusters(same)
    repeated = [(1, v) for _, v in vectors(12)]
    assert sorted(map(tuple, subvectors.cluster_vectors(frame_of(spark, repeated)).collect()), key=str) == brute_clusters(repeated)


def test_dictionaries_lose_nothing():
    data = subvectors.integers(np.array([v for _, v in vectors(40)] + [v for _, v in vectors(40)]))
    row = subvectors.encode([*range(79), None], data)
    ids, known, blocks = subvectors.decoded({k: v[0] for k, v in row.items()})
    assert ids[:79].tolist() == [*range(79)] and known.tolist() == [True] * 79 + [False]
    assert all(len(distinct) <= 40 for _, distinct in blocks)
    assert np.array_equal(np.concatenate([distinct[codes] for codes, distinct in blocks], axis=1), data)


def test_a_chunk_of_distinct_subvectors_is_read_back():
    data = np.random.default_rng(2).permutation(subvectors.CHUNK * 64).reshape(-1, 64)
    row = subvectors.encode([*range(len(data))], data)
    _, _, blocks = subvectors.decoded({k: v[0] for k, v in row.items()})
    assert np.array_equal(np.concatenate([distinct[codes] for codes, distinct in blocks], axis=1), data)


def test_clusters_of_full_chunks(spark, monkeypatch):
    # 16,400 vectors in one task: a full chunk, whose first block holds each vector's own number, and another one
    rows = spark.range(0, 16_400, 1, 1).select(F.col("id").alias("vec_id"), F.concat(F.array((F.col("id") / 1024).cast("float")), F.array_repeat(F.lit(0.0).cast("float"), 63)).alias("embedding"))
    whole = sorted(map(tuple, subvectors.cluster_vectors(rows).collect()))
    monkeypatch.setattr(subvectors, "CHUNK", 500)
    assert [r[0] for r in whole] == [*range(16_400)] and whole == sorted(map(tuple, subvectors.cluster_vectors(rows).collect()))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(common.BATCH_ROWS)


def test_huge_components_are_refused():
    with pytest.raises(OverflowError):
        subvectors.integers(np.array([[1e30]]))
