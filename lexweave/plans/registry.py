"""All queries of the document-review operators, and DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexweave.plans import drafted, evidence, exports, folds, intake, passages, rollups, worklists

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = rollups.QUERIES | evidence.QUERIES | worklists.QUERIES | drafted.QUERIES | passages.QUERIES | exports.QUERIES | folds.QUERIES | intake.QUERIES
ORACLE_SQL: dict[str, str] = rollups.ORACLE_SQL | evidence.ORACLE_SQL | worklists.ORACLE_SQL | drafted.ORACLE_SQL | passages.ORACLE_SQL | exports.ORACLE_SQL | folds.ORACLE_SQL | intake.ORACLE_SQL
FLAGSHIP = "lexical_rank"
