"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Rows in an Arrow batch; texts may be long, so a batch stays small.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; in local mode one of its own where the session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("a cluster needs a shared folder in spark.checkpoint.dir")
        path = tempfile.mkdtemp(prefix="lexweave-shared-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def stage(df: DataFrame, label: str, **options: int) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage and survives lost executors. ``options`` are
    those of the writer, with _ for a dot."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexweave-{label}-{uuid.uuid4().hex}"
    df.write.options(**{k.replace("_", "."): v for k, v in options.items()}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spent(*staged: DataFrame) -> None:
    """Deletes what ``stage`` wrote, once everything that reads it has been written itself.

    Tables on file systems that Arrow does not know stay for whoever clears the folder.
    """
    for df in staged:
        folder = next((f.rsplit("/", 1)[0] for f in df.inputFiles()), "")
        if "/lexweave-" in folder and folder.split(":")[0] in ("file", "hdfs"):
            fs, path = pafs.FileSystem.from_uri(folder)
            fs.delete_dir(path)


_caches: dict[str, Callable[[], None]] = {}


def keeps_cache(module: str, clear: Callable[[], None]) -> None:
    """Tells how to empty what a module keeps in a worker from task to task."""
    _caches[module] = clear


def drop_other_caches(module: str) -> None:
    """Empties what other modules keep: a worker that has moved on to another operator needs the memory."""
    for owner, clear in _caches.items():
        if owner != module:
            clear()


def batch_rows(spark: SparkSession, rows: int | None = None) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows or BATCH_ROWS))


def map_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, rows: int | None = None) -> DataFrame:
    """``mapInArrow`` with batches that stay small although texts can be long. Workers run many tasks: each gives back the
    memory that Arrow has kept. Batches of fewer ``rows`` hold for what runs until ``batch_rows`` sets another number."""
    batch_rows(df.sparkSession, rows)

    module = fn.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_other_caches(module)
        yield from fn(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def make_room(cache: dict, most: int) -> None:
    """Drops the older half of a full cache; what is frequent soon returns."""
    if len(cache) >= most:
        for key in list(islice(cache, most // 2)):
            del cache[key]


def frame(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in columns.values()], names=list(columns))
