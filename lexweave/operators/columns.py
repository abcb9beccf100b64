"""Helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression that names a value and computes it once, where Spark would compute each mention of it."""
    return F.transform(F.array(value), body)[0]
