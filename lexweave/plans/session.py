"""Makes this package importable in Python workers, and finds the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parents[1]


@lru_cache(maxsize=1)
def _archive() -> str:
    path = os.path.join(tempfile.mkdtemp(prefix="lexweave-"), "lexweave.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent))
    return path


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors once for each application; Spark serves the file and keeps it for retries."""
    sc = spark.sparkContext
    if not any(name.endswith("/lexweave.zip") for name in sc.listFiles):
        sc.addPyFile(_archive())
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode one of its own where the session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("a cluster needs a shared folder in spark.checkpoint.dir")
        path = tempfile.mkdtemp(prefix="lexweave-shared-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that what follows reads it and does not compute it again."""
    path = f"{shared_dir(df.sparkSession)}/lexweave-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
