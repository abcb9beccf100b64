"""Sharding by longest processing time first: groups that must stay together, largest first, to the least loaded shard.

Groups are counted by size, and the heap deals whole counts: where the shards are level, equal groups go round in turns,
which can be taken in one step and gives the same loads as placing each group by itself. A group then finds its shard by
its rank among the groups of its size. Sizes are told apart by their leading ``BITS`` bits: exactly below 2 ** BITS bytes,
to one part in 2 ** (BITS - 1) above. The driver so sees at most (65 - BITS) * 2 ** (BITS - 1) counts, about 55,000,
however many groups there are.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.llm.common import stage, table

BITS = 11
ROWS_IN_CELL = 50_000
#: Groups with at least one row in so many are broadcast to their rows; there can be no more of them than this.
HOT_GROUPS = 4_096


def deal(counts: list[tuple[float, int]], shards: int) -> list[list[int]]:
    """Longest processing time first over (size, number of groups): how many groups of each entry each shard takes.

    Entries come in falling size; ties between shards go to the lower one.
    """
    heap = [(0.0, s) for s in range(shards)]
    dealt = []
    for size, left in counts:
        takes = [0] * shards
        while left:
            least = heap[0][0]
            level = [x for x in heap if x[0] <= least + size]
            above = min((x[0] for x in heap if x[0] > least + size), default=None)
            turns = left // len(level)
            if above is not None:
                turns = min(turns, int((above - max(level)[0]) // size))
            if turns > 0:
                for _, s in level:
                    takes[s] += turns
                heap = [(load + turns * size, s) if load <= least + size else (load, s) for load, s in heap]
                heapq.heapify(heap)
                left -= turns * len(level)
            else:
                load, s = heapq.heappop(heap)
                takes[s] += 1
                heapq.heappush(heap, (load + size, s))
                left -= 1
        dealt.append(takes)
    return dealt


def size_class(size: Column) -> Column:
    """A long that grows with ``size`` and keeps its leading BITS bits."""
    shift = F.greatest(F.length(F.bin(size)) - BITS, F.lit(0))
    return (shift * (1 << BITS)).cast("long") + F.call_function("shiftright", size, shift)


def numbered(rows: DataFrame, within: str, order: list[str], n_rows: int, name: str) -> DataFrame:
    """Numbers rows from 0 without gaps in each ``within``, in cells of bounded size: a cell starts where those before it end."""
    cells = max(64, n_rows // ROWS_IN_CELL)
    celled = rows.withColumn("cell", F.pmod(F.xxhash64(*order), F.lit(cells)))
    at = F.row_number().over(Window.partitionBy(within, "cell").orderBy(*order)) - 1
    counts = celled.groupBy(within, "cell").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(within).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(within, "cell", before.alias("before"))
    return celled.withColumn("at", at).join(starts, [within, "cell"]).withColumn(name, (F.col("before") + F.col("at")).cast("long")).drop("cell", "at", "before")


def assign(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Per document row: doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard).

    Groups are equal texts; rows without a text (null) are groups of their own, by doc_id. The size is the text's UTF-8
    bytes plus 1; groups of one size are dealt by the digest of their text. Equal rows stay apart and take slots of their
    own; a null doc_id is placed like any other; an empty table gives no rows; other columns are ignored, whatever their
    names.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    alone = F.concat(F.lit("null text of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("no document")))
    rows = stage(
        docs.select(
            F.col("doc_id").cast("long"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
            F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
            F.unhex(F.when(text.isNull(), F.sha2(alone, 224)).otherwise(F.sha2(text, 256))).alias("group"),
        ),
        "sized",
    )
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    groups = stage(groups.withColumn("class", size_class(F.col("bytes"))), "groups")
    classes = groups.groupBy("class").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).collect()
    classes.sort(key=lambda r: -r["class"])
    ends = []
    for r, takes in zip(classes, deal([(r["bytes"] / r["n"], r["n"]) for r in classes], shards)):
        ends.append((r["class"], [sum(takes[: s + 1]) for s in range(shards)]))
    n_groups, n_rows = sum(r["n"] for r in classes), sum(r["rows"] for r in classes)

    plan = F.broadcast(spark.createDataFrame(ends, "class long, ends array<long>"))
    ranked = numbered(groups, "class", ["group"], n_groups, "rank").join(plan, "class")
    shard = F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard")
    homes = stage(ranked.select("group", "rows", shard), "homes")
    is_hot = F.col("rows") * HOT_GROUPS >= n_rows
    hot = F.broadcast(homes.where(is_hot).select("group", "shard"))
    placed = rows.join(hot, "group").unionByName(rows.join(hot, "group", "left_anti").join(homes.where(~is_hot).select("group", "shard"), "group"))
    return numbered(placed, "shard", ["doc_id", "group"], n_rows, "slot").select("doc_id", "size", "text_crc32", "shard", "slot")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
