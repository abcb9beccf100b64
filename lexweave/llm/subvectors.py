"""Centroid clustering over subvector dictionaries.

Vectors of integers are cut into blocks of dimensions. In chunks of rows each block is dictionary-encoded without loss
into its distinct subvectors, as columnar files do with values. A round computes the exact distance of each distinct
subvector to the centroids' blocks once and adds these partial distances up by code. Chunks are written once and stay
where they are: a round moves sums by cluster and dimension only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import batch_rows, frame, map_rows, spent, stage, table

DIMS, CLUSTERS, ROUNDS, SCALE = 64, 8, 10, 1024
#: Dimensions of a block.
WIDTH = 4
#: Vectors of a chunk, whose integers take 4 MB.
CHUNK = 16_384
#: Chunks that are read at a time, which are those of a row group where they are stored.
AT_ONCE = 4
#: Beyond this size a squared distance of 64 components might not fit in a long; an int holds the component itself.
LIMIT = 1 << 27
CHUNKS = "vec_ids binary, known binary, codes array<binary>, dictionary array<binary>"


def usable(embedding: Column, dims: int = DIMS) -> Column:
    """Whether a vector has all components, none null or non-finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(embedding) == dims) & finite, F.lit(False))


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 * x) of each component; the product by a power of two is exact."""
    scaled = np.floor(SCALE * vectors.astype(np.float64))
    if scaled.size and np.abs(scaled).max() > LIMIT:
        raise OverflowError(f"components of over {LIMIT // SCALE} have squared distances that a long can't hold")
    return scaled.astype(np.int64)


def encode(vec_ids: list[int | None], vectors: np.ndarray) -> dict[str, list]:
    """A chunk as a row: the distinct subvectors of each block, and for each vector its code in each block."""
    codes, dictionary = [], []
    for at in range(0, vectors.shape[1], WIDTH):
        block = np.ascontiguousarray(vectors[:, at : at + WIDTH], np.int32)
        # equal bytes are equal subvectors
        distinct, code = np.unique(block.view(np.dtype((np.void, block.shape[1] * 4))).ravel(), return_inverse=True)
        codes.append(code.astype(np.uint16).tobytes())
        dictionary.append(distinct.tobytes())
    ids = np.array([i or 0 for i in vec_ids], np.int64)
    return {"vec_ids": [ids.tobytes()], "known": [np.array([i is not None for i in vec_ids], np.bool_).tobytes()], "codes": [codes], "dictionary": [dictionary]}


def chunked(vectors: DataFrame, dims: int) -> DataFrame:
    """(vec_id, embedding) as encoded chunks; a task's last chunk may be smaller."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        parts: list[np.ndarray] = []

        def emit() -> pa.RecordBatch:
            row = encode(ids, np.concatenate(parts))
            ids.clear()
            parts.clear()
            return frame({"vec_ids": (row["vec_ids"], pa.binary()), "known": (row["known"], pa.binary()), "codes": (row["codes"], pa.list_(pa.binary())), "dictionary": (row["dictionary"], pa.list_(pa.binary()))})

        for b in batches:
            if b.num_rows:
                ids += b.column("vec_id").to_pylist()
                parts.append(integers(b.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)))
                if len(ids) + b.num_rows > CHUNK:
                    yield emit()
        if ids:
            yield emit()

    return map_rows(vectors, run, CHUNKS)


def decoded(row: dict) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The ids of a chunk, which of them are known, and (codes, distinct subvectors) of each block."""
    blocks = [(np.frombuffer(c, np.uint16), np.frombuffer(d, np.int32).astype(np.int64)) for c, d in zip(row["codes"], row["dictionary"], strict=True)]
    ids = np.frombuffer(row["vec_ids"], np.int64)
    # a Python integer: a whole chunk of distinct subvectors has more components than a code can count
    return ids, np.frombuffer(row["known"], np.bool_), [(c, d.reshape(int(c.max()) + 1, -1)) for c, d in blocks]


def nearest(blocks: list[tuple[np.ndarray, np.ndarray]], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, the smaller number of equals, and its squared distance."""
    total, at = 0, 0
    for codes, distinct in blocks:
        part = centroids[:, at : at + distinct.shape[1]]
        once = ((distinct[:, None, :] - part[None, :, :]) ** 2).sum(axis=2)
        total = total + once[codes]
        at += distinct.shape[1]
    best = total.argmin(axis=1)
    return best, total[np.arange(len(best)), best]


def cluster_sums(chunks: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """cluster -> (vectors, sums of their components), summed by Spark; only a row for each cluster and dimension comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                _, _, blocks = decoded(row)
                best, _ = nearest(blocks, centroids)
                at, sums = 0, np.zeros(centroids.shape, np.int64)
                for codes, distinct in blocks:
                    for cluster in np.unique(best):
                        uses = np.bincount(codes[best == cluster], minlength=len(distinct))
                        sums[cluster, at : at + distinct.shape[1]] = uses @ distinct
                    at += distinct.shape[1]
                counts = np.bincount(best, minlength=len(centroids))
                cluster, dim = np.nonzero(np.repeat(counts[:, None] > 0, centroids.shape[1], axis=1))
                yield frame({"cluster": (cluster, pa.int32()), "dim": (dim, pa.int32()), "n": (counts[cluster], pa.int64()), "total": (sums[cluster, dim], pa.int64())})

    parts = map_rows(chunks, run, "cluster int, dim int, n long, total long", AT_ONCE)
    found: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("cluster", "dim").collect():
        found.setdefault(r["cluster"], (r["n"], []))[1].append(r["total"])
    return found


def first_centroids(vectors: DataFrame, clusters: int) -> np.ndarray:
    """The vectors whose ids have the smallest digests; rows of one id go by their components."""
    digest = F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    chosen = vectors.select("embedding", digest.alias("digest")).orderBy("digest", "embedding").limit(clusters).collect()
    return integers(np.array([r["embedding"] for r in chosen], np.float64))


def assign(chunks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids, known, blocks = decoded(row)
                best, distance = nearest(blocks, centroids)
                columns = [pa.array(ids, pa.int64(), mask=~known), pa.array(best, pa.int32()), pa.array(distance, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    return map_rows(chunks, run, "vec_id long, cluster int, distance long", AT_ONCE)


def centroid_digests(centroids: Iterable[Iterable[int]]) -> list[str]:
    return [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centroids]


def cluster_vectors(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS) -> DataFrame:
    """Per usable vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Null vectors and those with another number of components, or with a null or non-finite one, have no row. Equal rows
    stay apart; a null vec_id keeps its row and counts as an empty one where the first centroids are chosen; with fewer
    vectors than clusters there are as many clusters as vectors. An empty table has no rows; other columns are ignored.
    Components of over 131,072 raise an error, as their squared distances do not fit in a long.
    """
    spark = embeddings.sparkSession
    kept = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(usable(F.col("embedding"), dims))
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = first_centroids(kept, clusters)
    if not len(centroids):
        return spark.createDataFrame([], schema)
    chunks = stage(chunked(kept, dims), "chunks", parquet_block_row_count_limit=AT_ONCE)
    for _ in range(rounds):
        for cluster, (n, sums) in cluster_sums(chunks, centroids).items():
            centroids[cluster] = [s // n for s in sums]
    assigned = stage(assign(chunks, centroids), "assigned")
    batch_rows(spark)
    inertia = {r["cluster"]: r["inertia"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    spent(chunks)
    rows = [(c, inertia[c], sum(inertia.values()), digest) for c, digest in enumerate(centroid_digests(centroids)) if c in inertia]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select(*[c.split()[0] for c in schema.split(", ")])


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """Each round as two steps: the nearest centroid by a window, then the floor of the means."""
    near = "SELECT vec_id, v, id AS cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance FROM k CROSS JOIN c{0} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, id) = 1"
    steps = []
    for i in range(ROUNDS):
        steps.append(f"a{i} AS MATERIALIZED ({near.format(i)})")
        means = f"SELECT cluster AS id, list(mean ORDER BY dim) AS c FROM (SELECT cluster, dim, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*))::BIGINT // count(*) AS mean FROM (SELECT cluster, unnest(v) AS x, unnest(range({DIMS})) AS dim FROM a{i}) GROUP BY ALL) GROUP BY cluster"
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT id, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN ({means}) m USING (id))")
    return f"""WITH k AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS id, v AS c FROM k ORDER BY sha256('3:' || vec_id) LIMIT {CLUSTERS}),
 {", ".join(steps)}, a AS MATERIALIZED ({near.format(ROUNDS)})
SELECT vec_id, CAST(cluster AS INT) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
 FROM a JOIN c{ROUNDS} ON id = cluster"""


ORACLE_SQL = _sql()
