"""As-of lookups within documents, block by block, so that no document is gathered in one group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Places of a block: a group holds the marks and questions of one block of a document.
BLOCK = 4096


def last_mark(asks: DataFrame, marks: DataFrame, block: int = BLOCK) -> DataFrame:
    """``asks`` with ``mark``: the last mark of the document at or before ``at``, null if it does not reach so far.

    ``asks`` has document and at among others, ``marks`` has document, at, until (the last place that it reaches) and
    mark; the ``at`` of a document's marks are different longs, and later marks reach as far at least. A mark goes to every block that it reaches, both tables
    are united and the marks filled forward: one exchange, and no pairs.
    """
    block_of = lambda at: F.floor(F.col(at) / block)
    nothing = F.lit(None)
    told = F.struct("until", "mark")
    asked = F.struct(*[F.col(c) for c in asks.columns])
    spread = marks.select("document", "at", F.explode(F.sequence(block_of("at"), block_of("until"))).alias("block"), told.alias("told"), nothing.alias("asked"))
    united = spread.unionByName(asks.select("document", F.col("at").cast("long").alias("at"), block_of("at").alias("block"), nothing.alias("told"), asked.alias("asked")))
    so_far = Window.partitionBy("document", "block").orderBy("at", F.col("asked").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = united.withColumn("told", F.last("told", ignorenulls=True).over(so_far)).where("asked IS NOT NULL")
    return filled.select("asked.*", F.when(F.col("told.until") >= F.col("at"), F.col("told.mark")).alias("mark"))
