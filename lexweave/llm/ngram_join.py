"""N-gram Jaccard self-join by PartEnum signatures.

A document is the set of its distinct word n-grams. Set sizes fall into bands so narrow that two sets of the wanted
similarity lie in one band or in neighbours; each set therefore works in the band of its own size and in the next.
Inside a band, similarity bounds the number of n-grams that only one of two sets has by some k. The hash domain of
n-grams is cut into n1 groups of n2 parts; with at most k differences some groups have at most k2 of them, so the two
sets agree on some subset of n2 - k2 parts there, and the hash of what a set holds in such a subset is a signature
that both share. With n1 above the least number, G groups are sure to agree, which allows two exact savings: empty
subsets are left out while a set has fewer than G of them, and only the fullest ``all - G + 1`` are sent.

Candidates are screened by exact bounds and then verified on the texts themselves. The bounds are those of the sizes and
of sketches: a sketch has the parity of a set's n-grams in each of two to four times as many buckets, and two sets differ
in at least as many n-grams as their sketches in bits, and hardly in more. Members of a signature group are first compared with its smallest member; only members that are still
in different components afterwards are compared with each other, so a group of copies costs as many comparisons as it
has members. Members of crowded groups, such as copies that drifted apart, are compared sketch by sketch in blocks, and only pairs that can be similar leave.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.llm.common import map_rows, spent, stage, table
from lexweave.llm.spans import maybe_in

_U = np.uint64
_MULT = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]

#: A signature group with more members in different components is compared block by block.
CROWD = 16
#: Documents in a block.
BLOCK = 2048
#: Equal texts are joined to their first one in so many parts, so that a text with many copies is no hot key.
SALTS = 16
#: Most buckets of a sketch, one bit each.
MAX_SKETCH = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def words(text: str | None) -> list[bytes]:
    """Lower-cases A-Z; words are what ASCII white space separates."""
    return text.encode().lower().split() if text else []


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; fewer words make one shingle, none an empty set."""
    w = np.fromiter(map(xxhash.xxh64_intdigest, words(text)), np.uint64)
    if not len(w):
        return w
    m = min(n, len(w))
    h = np.full(len(w) - m + 1, m, np.uint64)
    for j in range(m):
        h = _mix(h + w[j : len(w) - m + 1 + j] * _MULT[j % len(_MULT)])
    return np.unique(h)


def same_enough(a: str, b: str, n: int, percent: int) -> bool:
    """100 * intersection >= percent * union, on the shingles themselves."""
    wa, wb = words(a), words(b)
    if not wa or not wb:
        return False
    seen: dict[bytes, int] = {}
    ids = [np.fromiter((seen.setdefault(w, len(seen) + 1) for w in x), np.int64, len(x)) for x in (wa, wb)]
    if (len(seen) + 1) ** n < 1 << 62:
        sets = []
        for x in ids:
            m = min(n, len(x))
            key = np.zeros(len(x) - m + 1, np.int64)
            for j in range(m):
                key = key * (len(seen) + 1) + x[j : len(x) - m + 1 + j]
            sets.append(np.unique(key))
        both = len(np.intersect1d(*sets, assume_unique=True))
    else:
        sets = [{tuple(x[i : i + n].tolist()) for i in range(max(1, len(x) - n + 1))} for x in ids]
        both = len(sets[0] & sets[1])
    return 100 * both >= percent * (len(sets[0]) + len(sets[1]) - both)


def sketch(hashes: np.ndarray) -> bytes:
    """The parity of the number of hashes in each of up to four times as many buckets, at least 64, one bit each."""
    bits = min(max(4 * len(hashes), 64), MAX_SKETCH).bit_length() - 1
    odd = np.bincount((hashes >> _U(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(data: bytes, size: int) -> np.ndarray:
    """A sketch in ``size`` bytes: that of the same hashes in fewer buckets."""
    bits = np.frombuffer(data, np.uint8)
    if len(bits) > size:
        bits = np.packbits(np.unpackbits(bits).reshape(size * 8, -1).sum(1, dtype=np.int64).astype(np.uint8) & 1)
    return bits.view(np.uint64)


def can_be_similar(a: bytes, b: bytes, size_a: int, size_b: int, percent: int) -> bool:
    """False where the sketches prove that two sets of these sizes differ too much."""
    least = min(len(a), len(b))
    differing = int(np.bitwise_count(folded(a, least) ^ folded(b, least)).sum())
    return (100 + percent) * differing <= (100 - percent) * (size_a + size_b)


class PartEnum:
    """Signatures of a set of 64-bit hashes for a Jaccard similarity of ``percent`` / 100."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.low, self.high = [1], []
        self._band(1 << 16)

    def _band(self, size: int) -> int:
        while not self.high or self.high[-1] < size:
            self.high.append(self.low[-1] * 100 // self.percent)
            self.low.append(self.high[-1] + 1)
        return int(np.searchsorted(self.high, size))

    @lru_cache(maxsize=4096)  # noqa: B019  one object lives as long as its worker
    def plan(self, band: int) -> tuple[int, int, int, int, np.ndarray]:
        """n1, n2, k2, the sure number of agreeing groups, and the bounds of the parts in the hash domain."""
        self._band(self.low[-1])
        most = self.high[band]
        k = 2 * most * (100 - self.percent) // (100 + self.percent)
        # Small sets take larger subsets, which are hardly ever empty: all sets with an empty one share its signature.
        n2, k2 = (1, 0) if k == 0 else (4, 1) if k == 1 else (5, 2) if k < 12 else (3, 1) if k < 48 else (2, 1)
        least = k // (k2 + 1) + 1
        n1 = least + least * 12 // 100
        parts = n1 * n2
        bounds = np.array([(j << 64) // parts for j in range(1, parts)], np.uint64)
        return n1, n2, k2, n1 - k // (k2 + 1), bounds

    def signatures(self, hashes: np.ndarray) -> np.ndarray:
        if not len(hashes):
            return hashes
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(hashes + _U(1)))))
        own = self._band(len(hashes))
        out = []
        for band in (own, own + 1):
            n1, n2, k2, sure, bounds = self.plan(band)
            edge = np.concatenate(([0], np.searchsorted(hashes, bounds), [len(hashes)]))
            content = (total[edge[1:]] - total[edge[:-1]]).reshape(n1, n2)
            size = np.diff(edge).reshape(n1, n2)
            key, count = [], []
            for c, subset in enumerate(combinations(range(n2), n2 - k2)):
                place = np.arange(n1, dtype=np.uint64) + _U((band << 40) + (c << 32) + 1)
                key.append(_mix(content[:, subset].sum(1, dtype=np.uint64) + _mix(place)))
                count.append(size[:, subset].sum(1))
            key, count = np.concatenate(key), np.concatenate(count)
            empty = int((count == 0).sum())
            if empty < sure:
                keep = len(key) - sure + 1
                if keep < len(key):  # the order is one of (content size, hash), the same for every set
                    key = key[np.lexsort((key, -count))[:keep]]
            out.append(key)
        return np.concatenate(out)


def _signature_rows(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(sig, doc_id, own): a row for each signature with own null, and one for each document with sig null. ``own`` has
    the set's size n and its sketch, which is null where another row of the same text has it."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme, seen = PartEnum(percent), {}
        for b in batches:
            ids, counts, sigs, sketches = b.column("doc_id").to_pylist(), [], [], []
            for i, text in zip(ids, b.column("text").to_pylist(), strict=True):
                digest = xxhash.xxh3_128_digest((text or "").encode())
                size, own, counted = seen.get(digest), [], None  # a copy within the task needs no signatures: copies are joined by their text
                if size is None:
                    h = shingles(text, n)
                    size = len(h)
                    if i is not None:
                        own, counted = scheme.signatures(h).view(np.int64), sketch(h)
                        if len(seen) < 200_000:
                            seen[digest] = size
                sigs.append(own)
                counts.append(size)
                sketches.append(counted)
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sigs])))
            flat = np.concatenate([np.asarray(s, np.int64) for s in sigs]) if sigs else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(sketches, pa.binary()), lists], ["doc_id", "n", "sketch", "sigs"])

    signed = map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), sign, "doc_id long, n long, sketch binary, sigs array<long>")
    own = F.struct("n", "sketch")
    none = F.lit(None).cast("struct<n: bigint, sketch: binary>")
    rows = F.array_insert(F.transform("sigs", lambda s: F.struct(s.alias("sig"), none.alias("own"))), 1, F.struct(F.lit(None).cast("long").alias("sig"), own.alias("own")))
    return signed.select("doc_id", F.explode(rows).alias("r")).select("r.sig", "doc_id", "r.own")


def connected(edges: DataFrame, label: str) -> DataFrame:
    """(node, component) of every node of (a, b); component is the smallest node. Large-star and small-star rounds."""
    edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        before, edges = edges, stage(small, label)
        spent(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents that can be among ``ids`` (one column); few others pass."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return maybe_in(named.where("text IS NOT NULL"), "doc_id", ids)


def _screened(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that sizes and sketches of ``sets`` (doc, size, sketch) don't rule out."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("sketch_a", "sketch_b", "size_a", "size_b"))
            ok = [can_be_similar(*row, percent) for row in zip(*columns, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left, right = (sets.select(F.col("doc").alias(c), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")
    fit = f"100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b)"
    joined = pairs.join(left, "a").join(right, "b").where(fit)
    return stage(map_rows(joined.select("a", "b", "sketch_a", "sketch_b", "size_a", "size_b"), look, "a long, b long"), "pairs")


def _verify(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose texts are similar enough."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = stage(_texts_of(docs, ids).dropDuplicates(["doc_id"]), "texts")
    left, right = (texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [same_enough(x, y, n, percent) for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    links = stage(map_rows(joined, compare, "a long, b long"), "links")
    spent(texts)
    return links


def _crowd_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of crowded signature groups that can be similar and are in different components.

    ``members`` has sig, head (of the group), doc, component and size. Groups that share members form a family; each of
    its documents is compared with those of its own and of the next band of sizes, block by block, by their sketches.
    """
    families = connected(members.select(F.col("doc").alias("a"), F.col("head").alias("b")), "families").select(F.col("node").alias("doc"), F.col("component").alias("family"))
    width = math.log(100 / percent) * 1.0001  # so that similar sets are at most one band apart in floating point too
    band = F.floor(F.log("size") / width)
    zones = F.explode(F.array(band, band + 1)).alias("zone")
    placed = stage(members.select("doc", "component", "size").distinct().join(families, "doc").select("doc", "component", "size", "family", zones), "families")
    blocks = placed.groupBy("family", "zone").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    in_block = placed.join(blocks, ["family", "zone"]).join(sets.select("doc", "sketch"), "doc").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = in_block.withColumn("other", other).select("family", "zone", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "doc", "component", "size", "sketch")

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        least = min(map(len, rows["sketch"]))
        left, right = rows[rows["block"] == key[2]], rows[rows["block"] == key[3]]
        bits = np.stack([folded(s, least) for s in right["sketch"]]) if len(right) else None
        size, doc, component = (right[c].to_numpy() for c in ("size", "doc", "component"))
        found = []
        for a, own, mine, data in zip(left["doc"], left["component"], left["size"], left["sketch"], strict=True):
            if bits is None:
                break
            differing = np.bitwise_count(bits ^ folded(data, least)).sum(1, dtype=np.int64)
            near = ((100 + percent) * differing <= (100 - percent) * (size + mine)) & (component != own)
            if key[2] == key[3]:
                near &= doc > a
            found.extend((min(a, b), max(a, b)) for b in doc[near].tolist())
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return dealt.groupBy("family", "zone", "lo", "hi").applyInPandas(compare, "a long, b long")


def _components(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """``similar_components`` of rows in which each doc_id has one text."""
    rows = _signature_rows(docs, n, percent)
    in_group = Window.partitionBy("sig").orderBy("doc_id")
    salted = rows.withColumn("sig", F.coalesce("sig", F.xxhash64(F.lit(7), "doc_id")))  # the documents' own rows ride along
    grouped = salted.withColumn("leader", F.first(F.when(F.col("own").isNull(), F.col("doc_id")), ignorenulls=True).over(in_group))
    kept = stage(grouped.where("own IS NOT NULL OR leader < doc_id"), "groups")
    sizes, members = kept.where("own IS NOT NULL").select("doc_id", F.col("own.n").alias("n_shingles")), kept.where("own IS NULL").select("sig", "leader", "doc_id")

    digests = _digests(docs).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    firsts = digests.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last").select("digest", "rep")
    firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    copies = stage(digests.join(firsts, ["digest", "salt"]).where("doc_id <> rep").select(F.col("doc_id").alias("copy"), "rep").distinct(), "copies")

    def to_reps(df: DataFrame, *columns: str) -> DataFrame:
        for c in columns:
            df = df.join(copies, df[c] == copies["copy"], "left").withColumn(c, F.coalesce("rep", c)).drop("copy", "rep")
        return df

    sent = kept.where("own.sketch IS NOT NULL AND own.n > 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("doc"), F.col("own.n").alias("size"), "own.sketch")
    sets = stage(to_reps(sent, "doc").dropDuplicates(["doc"]), "sets")
    starts = members.select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()
    first = stage(to_reps(starts, "a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "starts")
    likely = _screened(first, sets, percent)
    links = _verify(docs, likely, n, percent)
    spent(likely)
    found = connected(links, "component")

    of_size = sets.select("doc", "size")
    everyone = members.select("sig", F.col("leader").alias("doc")).distinct().unionByName(members.select("sig", F.col("doc_id").alias("doc")))
    placed = to_reps(everyone, "doc").distinct().join(found, F.col("doc") == F.col("node"), "left").select("sig", "doc", F.coalesce("component", "doc").alias("component"))
    mixed = placed.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("sig")
    open_ = stage(placed.join(mixed, "sig", "left_semi").join(of_size, "doc"), "open")
    crowded = stage(open_.groupBy("sig").agg(F.count("*").alias("n"), F.min("doc").alias("head")).where(F.col("n") > CROWD).select("sig", "head"), "crowded")
    quiet = open_.join(crowded, "sig", "left_anti")
    x, y = (quiet.select("sig", F.col("doc").alias(c), F.col("component").alias(f"component_{c}"), F.col("size").alias(f"size_{c}")) for c in "ab")
    fit = f"100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b)"
    rest = x.join(y, "sig").where(f"a < b AND component_a <> component_b AND {fit}").select("a", "b").distinct().join(first, ["a", "b"], "left_anti")
    others = _screened(rest, sets, percent)
    crowd = stage(_crowd_pairs(open_.join(crowded, "sig"), sets, percent).distinct().join(first, ["a", "b"], "left_anti"), "pairs")
    more = _verify(docs, others.unionByName(crowd).distinct(), n, percent)

    no_ids = copies.select(F.col("copy").alias("a"), F.col("rep").alias("b"))
    final = connected(links.unionByName(more).unionByName(no_ids), "component")
    spent(first, sets, open_, crowded, others, crowd, links, more, copies)
    return sizes.join(final, sizes["doc_id"] == final["node"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _digests(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.col("text").cast("string"), 256)).alias("digest"))


def similar_components(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id (smallest doc_id that links reach).

    A null or empty text, or one of white space, has no shingles, links with nothing and is its own component. Rows that
    share a doc_id are one document for the components, linked by any of their texts; n_shingles is the row's own. A
    null doc_id cannot be linked: its component is null. An empty table has an empty result. Other columns of the input
    are ignored, whatever their names.
    """
    several = _digests(docs).groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi")
    if several.isEmpty():
        return _components(docs, n, percent)
    keyed = stage(docs.select(F.monotonically_increasing_id().alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "rows")
    found = stage(_components(keyed.where("doc_id IS NOT NULL").select(F.col("row_key").alias("doc_id"), "text"), n, percent).withColumnRenamed("doc_id", "row_key"), "rows")
    named = found.join(keyed.select("row_key", "doc_id"), "row_key")
    heads = named.groupBy("doc_id").agg(F.min("row_key").alias("head"))
    ties = named.join(heads, "doc_id").select(F.col("row_key").alias("a"), F.col("head").alias("b"))
    nodes = connected(ties.unionByName(named.select(F.col("row_key").alias("a"), F.col("component_id").alias("b"))), "component")
    grouped = stage(named.join(nodes, named["row_key"] == nodes["node"], "left").select("doc_id", "n_shingles", F.coalesce("component", "row_key").alias("component")), "rows")
    least = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    nameless = keyed.where("doc_id IS NULL").select(F.col("row_key").alias("doc_id"), "text")
    unlinked = _signature_rows(nameless, n, percent).where("own IS NOT NULL").select(F.lit(None).cast("long").alias("doc_id"), F.col("own.n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return grouped.join(least, "component").select("doc_id", "n_shingles", "component_id").unionByName(unlinked)


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with its own columns: the smallest doc_id, and the first row among its rows.

    Groups are of rows: rows that repeat a doc_id with different texts are documents of their own, and rows without a
    doc_id belong to groups as any others. Rows without words stay, and columns of any names are carried along.
    """
    columns = docs.columns
    keyed = stage(docs.select(F.monotonically_increasing_id().alias("row_key"), F.struct(*[docs[c] for c in columns]).alias("row")), "rows")
    texts = keyed.select(F.col("row_key").alias("doc_id"), F.col("row.text").cast("string").alias("text"))
    placed = _components(texts, n, percent).where("n_shingles > 0").select(F.col("doc_id").alias("row_key"), "component_id")
    ids = keyed.select("row_key", F.col("row.doc_id").cast("long").alias("doc_id"))
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_key")
    shared = stage(placed.groupBy("component_id").agg(F.count("*").alias("rows")).where("rows > 1").join(placed, "component_id").join(ids, "row_key").select("component_id", order.alias("place")), "shared")
    first = shared.groupBy("component_id").agg(F.min("place").alias("first"))
    gone = shared.join(first, "component_id").where("place <> first").select("place.row_key")
    return keyed.join(gone, "row_key", "left_anti").select("row.*")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"), n=4, percent=85)


def reference(docs: list[tuple], n: int = 4, percent: int = 85) -> list[tuple]:
    """Brute force for tests: compares all pairs; (doc_id, n_shingles, component_id) for distinct doc_ids."""
    sets = {}
    for i, text in docs:
        w = words(text)
        sets[i] = {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    return [(i, len(sets[i]), root(i)) for i, _ in docs]
