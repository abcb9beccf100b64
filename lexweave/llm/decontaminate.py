"""Benchmark decontamination by a broadcast set of normalised n-grams.

Benchmark texts are cut into windows of ``n`` words (an item with fewer words is one window). The windows are
broadcast in blocks of at most ``block_windows``, so what is sent to executors has a fixed bound and a larger
benchmark takes more passes instead of more memory. Each pass scans the document windows with a rolling hash,
verifies each hit word by word, and reports the hit word positions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import frame, map_rows, stage, table

WINDOW = 10
#: Windows in one broadcast: about 200 bytes each.
BLOCK_WINDOWS = 250_000

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cases A-Z and returns the runs of ASCII letters, digits and non-ASCII characters."""
    return text.encode().translate(_FOLD).split() if text else []


def item_windows(text: str | None, n: int) -> list[bytes]:
    w = words(text)
    return [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


class WindowIndex:
    """Windows by length: exact word-id rows behind a 64-bit hash, and the items that own each."""

    def __init__(self, windows: list[tuple[bytes, list]]) -> None:
        self.vocab: dict[bytes, int] = {}
        self.by_len: dict[int, tuple[np.ndarray, list[tuple[tuple[int, ...], list]]]] = {}
        rows: dict[int, list] = {}
        for text, items in windows:
            ids = tuple(self.vocab.setdefault(w, len(self.vocab) + 1) for w in text.split(b" "))
            rows.setdefault(len(ids), []).append((self._key(np.array(ids, np.uint64)[:, None])[0], ids, items))
        for n, found in rows.items():
            found.sort(key=lambda r: r[0])
            self.by_len[n] = (np.array([r[0] for r in found], np.uint64), [r[1:] for r in found])

    @staticmethod
    def _key(columns: np.ndarray) -> np.ndarray:
        key = np.zeros(columns.shape[1], np.uint64)
        for c in columns:
            key = (key ^ c) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return key

    def scan(self, doc: list[bytes]) -> tuple[set[int], set]:
        """Hit word positions and owning items of one document."""
        hit: set[int] = set()
        items: set = set()
        ids = np.fromiter(map(self.vocab.get, doc, repeat(0)), np.uint64, len(doc))
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        for n, (keys, rows) in self.by_len.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(at):
                continue
            key = self._key(np.stack([ids[at + j] for j in range(n)]))
            left = np.searchsorted(keys, key)
            for p, k, i in zip(at.tolist(), key.tolist(), left.tolist(), strict=True):
                while i < len(keys) and int(keys[i]) == k:
                    if tuple(ids[p : p + n].tolist()) == rows[i][0]:
                        hit.update(range(p, p + n))
                        items.update(rows[i][1])
                    i += 1
        return hit, items


def _windows(benchmark: DataFrame, n: int) -> DataFrame:
    """One row for each distinct window, with the items that own it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(str(i), g) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if i is not None for g in set(item_windows(t, n))]
            yield frame({"item_id": ([p[0] for p in pairs], pa.string()), "gram": ([p[1] for p in pairs], pa.binary())})

    cut_rows = map_rows(benchmark.select(F.col("item_id"), F.col("text").cast("string")), cut, "item_id string, gram binary")
    return cut_rows.groupBy("gram").agg(F.collect_set("item_id").alias("items"))


def find_overlaps(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block_windows: int = BLOCK_WINDOWS, digests: bool = False) -> DataFrame:
    """Per document row: doc_id, n_words, hit (sorted word positions), items (sorted item ids as strings).

    Nulls and empty texts have no words and no hits; a null item_id owns no window; equal rows give equal rows.
    Other columns of the inputs are ignored. The result keeps one row for each input row. With ``digests`` a column
    digest (SHA-256 of the text, null as empty) follows.
    """
    spark = docs.sparkSession
    added = [F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)).alias("digest")] if digests else []
    windows = stage(_windows(benchmark, n), "windows")
    n_blocks = max(1, -(-windows.count() // block_windows))
    keyed = docs.select("doc_id", "text")
    if n_blocks > 1:  # rows need an identity of their own to meet again after several passes
        keyed = stage(keyed.withColumn("row_key", F.monotonically_increasing_id()), "keyed")
    else:
        keyed = keyed.withColumn("row_key", F.lit(0).cast("long"))
    out = None
    for k in range(n_blocks):
        block = windows.where(F.pmod(F.xxhash64("gram"), F.lit(n_blocks)) == k).toLocalIterator()
        sent = spark.sparkContext.broadcast(sorted((bytes(r["gram"]), sorted(r["items"])) for r in block))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = WindowIndex(sent.value)
            for b in batches:
                counts, hits, owners = [], [], []
                for text in b.column("text").to_pylist():
                    w = words(text)
                    hit, items = index.scan(w) if w else ((), ())
                    counts.append(len(w))
                    hits.append(sorted(hit))
                    owners.append(sorted(items))
                own = {"digest": (b.column("digest").to_pylist(), pa.binary())} if digests else {}
                yield frame(own | {"doc_id": (b.column("doc_id").to_pylist(), pa.int64()), "row_key": (b.column("row_key").to_pylist(), pa.int64()), "n_words": (counts, pa.int64()), "hit": (hits, pa.list_(pa.int32())), "items": (owners, pa.list_(pa.string()))})

        found = map_rows(keyed.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "row_key", *added), scan, ("digest binary, " if digests else "") + "doc_id long, row_key long, n_words long, hit array<int>, items array<string>")
        out = found if out is None else out.unionByName(found)
    if n_blocks > 1:
        out = out.groupBy("row_key").agg(
            *[F.first(c).alias(c) for c in ("doc_id", "digest")[: 1 + digests]],
            F.first("n_words").alias("n_words"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit")))).alias("hit"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
    return out.select("doc_id", "n_words", "hit", "items", *(["digest"] if digests else []))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """Documents without any hit, with their own columns. The text alone decides, whatever the doc_id."""
    columns = docs.columns
    named = docs.select(F.struct(*[docs[c] for c in columns]).alias("row"), F.unhex(F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256)).alias("digest"))
    dirty = find_overlaps(docs.select("doc_id", "text"), benchmark, n, digests=True).where(F.size("hit") > 0).select("digest").distinct()
    return named.join(dirty, "digest", "left_anti").select("row.*")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )


def reference(docs: list[tuple], bench: list[tuple], n: int = WINDOW) -> list[tuple]:
    """Brute force for tests: (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    out = []
    for doc_id, text in docs:
        w, hit, items = words(text), set(), set()
        for item_id, item in bench:
            for g in {tuple(g.split(b" ")) for g in item_windows(item, n)}:
                for p in range(len(w) - len(g) + 1):
                    if tuple(w[p : p + len(g)]) == g:
                        hit.update(range(p, p + len(g)))
                        items.add(str(item_id))
        out.append((doc_id, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return out


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hits AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN win ON dw.gram = win.gram AND dw.n = win.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
own AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN own USING (doc_id)
"""
