"""Merkle manifest of a table: leaf digests, a tree for each language, a tree over their roots, and proofs.

Nodes are rows (tree, idx, digest). On every level the first node of each run of ``ARITY`` equijoins the others by their
computed indices, one join for each slot offset, and the slot-zero rows so found emit the parents. Levels are written to
the shared folder; only the height of the highest tree reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.llm.common import spent, stage, table

ARITY = 8
#: Counts of partitions and trees are broadcast up to so many rows (about 100 bytes each), and joined by key beyond.
MAX_BROADCAST = 50_000
#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def joined_digest(*parts: Column) -> Column:
    """H: lowercase hex sha256 of the parts joined."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value with its length before it, so that fields can't run into each other; ``-`` without a value."""
    written = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(written).cast("string"), F.lit(":"), written), F.lit("-"))


def leaf_digest(docs: DataFrame, text: Column | None = None) -> Column:
    return joined_digest(*[field(text if name == "text" and text is not None else docs[name]) for name in FIELDS])


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``idx`` (gapless from 0 in each ``tree``) and ``n`` (the tree's rows), ascending by ``order``.

    Rows are dealt by ranges of the whole order, written, and numbered within their file: a file's numbers start where
    those of the files before it end, so no tree is gathered in one task. ``salt`` parts rows that are equal otherwise.
    """
    dealt = rows.repartitionByRange("tree", *order, "salt").sortWithinPartitions("tree", *order)
    at = F.monotonically_increasing_id()
    dealt = stage(dealt.drop("salt").withColumn("part", F.floor(at / (1 << 33))).withColumn("at", at.bitwiseAND((1 << 33) - 1)), "dealt")
    counts = dealt.groupBy("tree", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    by_tree = Window.partitionBy("tree").orderBy("part")
    before = F.coalesce(F.sum("rows").over(by_tree.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stage(counts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(Window.partitionBy("tree")).alias("n")), "starts")
    small = starts.count() <= MAX_BROADCAST
    found = dealt.join(F.broadcast(starts) if small else starts, ["tree", "part"])
    found = stage(found.withColumn("idx", F.col("at") + F.col("shift")).drop("part", "at", "shift"), "numbered")
    spent(dealt, starts)
    return found


def parents(nodes: DataFrame) -> DataFrame:
    """One level up: (tree, idx, n, digest, members), members being the digests of the run in order.

    A node's index tells its run and slot; the node in slot k of the same run is found by an equijoin on the index that
    it must have. Both sides are dealt by run, so that the joins of a level share one exchange.
    """
    run, slot = F.call_function("div", F.col("idx"), F.lit(ARITY)), F.col("idx") % ARITY
    placed = nodes.select("tree", "n", "digest", run.alias("run"), "idx", slot.alias("slot")).repartition("tree", "run")
    found = placed.where("slot = 0").select("tree", "n", "run", F.col("idx").alias("zero"), F.col("digest").alias("d0"))
    for k in range(1, ARITY):
        sibling = placed.where(F.col("slot") == k).select("tree", "run", (F.col("idx") - k).alias("zero"), F.col("digest").alias(f"d{k}"))
        found = found.join(sibling, ["tree", "run", "zero"], "left")
    members = F.array_compact(F.array(*[F.col(f"d{k}") for k in range(ARITY)]))
    up = found.select("tree", F.col("run").alias("idx"), F.call_function("div", F.col("n") + (ARITY - 1), F.lit(ARITY)).alias("n"), members.alias("members"))
    return up.withColumn("digest", joined_digest(F.array_join("members", "")))


def grow(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """All levels above (tree, idx, n, digest), and the roots (tree, digest, height)."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels: list[DataFrame] = []
    roots = nodes.where("n = 1").select("tree", "digest", F.lit(0).alias("height"))
    while most > 1:
        nodes = stage(parents(nodes.where("n > 1")), "level")
        levels.append(nodes)
        roots = roots.unionByName(nodes.where("n = 1").select("tree", "digest", F.lit(len(levels)).alias("height")))
        most = -(-most // ARITY)
    return levels, roots


def parent_paths(levels: list[DataFrame], roots: DataFrame) -> DataFrame:
    """(tree, run, path, root columns): for each run of leaves its members, then those of the runs above it, up to the
    root. ``roots`` has (tree, height, path, ...); its path goes on after the tree's. A lone leaf's run has only that.

    An element of a path has the members of a run; the slot in it follows from the index of the leaf.
    """
    kept = [c for c in roots.columns if c not in ("tree", "height", "path")]
    top = lambda height: roots.where(F.col("height") == height).select("tree", F.lit(0).cast("long").alias("run"), F.array().cast("array<array<string>>").alias("path"), F.col("path").alias("rest"), *kept)
    above = top(len(levels))
    for height in range(len(levels) - 1, -1, -1):
        own = levels[height].withColumnRenamed("idx", "node").withColumn("run", F.call_function("div", F.col("node"), F.lit(ARITY)))
        # the root of a tree is the only node of its level and stands in ``above`` as run 0
        down = own.select("tree", "node", "members", F.when(F.col("n") > 1, F.col("run")).otherwise(0).alias("run")).join(above, ["tree", "run"])
        above = down.select("tree", F.col("node").alias("run"), F.concat(F.array("members"), "path").alias("path"), "rest", *kept).unionByName(top(height))
    return above


def folded(path: Column, idx: Column, digest: Column, siblings: Column) -> Column:
    """A node's digest folded with the runs of a path, and its siblings appended to ``siblings``."""
    start = F.struct(idx.alias("at"), digest.alias("digest"), siblings.alias("siblings"))

    def step(acc: Column, members: Column) -> Column:
        slot = (acc["at"] % ARITY).cast("int")
        left, right = F.slice(members, F.lit(1), slot), F.slice(members, slot + 2, F.lit(ARITY))
        left, right = F.array_join(left, ""), F.array_join(right, "")
        return F.struct(F.call_function("div", acc["at"], F.lit(ARITY)).alias("at"), joined_digest(left, acc["digest"], right).alias("digest"), F.concat(acc["siblings"], left, right).alias("siblings"))

    return F.aggregate(path, start, step)


def manifest(docs: DataFrame, tampered: Column | None = None, text: Column | None = None) -> DataFrame:
    """Per document row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves ascend by doc_id within their language, a null doc_id first and equal ones by their leaf; a null language is
    a tree of its own, the first. Where ``tampered`` holds, the leaf that is folded has ``text`` in place of the row's.
    Null fields are written ``-`` and so differ from empty ones. Equal rows are leaves of their own; an empty table has
    no rows; other columns are ignored, whatever their names.
    """
    changed = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    leaf = leaf_digest(docs)
    other = leaf if text is None else F.when(changed, leaf_digest(docs, text)).otherwise(leaf)
    lang = docs["lang"].cast("string")
    tree = F.when(lang.isNull(), "0").otherwise(F.concat(F.lit("1"), lang))
    leaves = stage(docs.select(tree.alias("tree"), docs["doc_id"].cast("long").alias("doc_id"), leaf.alias("digest"), other.alias("other"), F.monotonically_increasing_id().alias("salt")), "leaves")
    placed = numbered(leaves, ["doc_id", "digest"])
    spent(leaves)
    levels, subroots = grow(placed.select("tree", "idx", "n", "digest"))
    subroots = stage(subroots, "subroots")

    ranked = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest", "height", F.lit(0).alias("salt")), ["name"])
    upper, root = grow(ranked.select("tree", "idx", "n", "digest"))
    tops = parent_paths(upper, root.withColumn("path", F.array().cast("array<array<string>>")).withColumnRenamed("digest", "root"))
    run = F.when(F.col("n") > 1, F.call_function("div", F.col("idx"), F.lit(ARITY))).otherwise(0)
    subtrees = stage(ranked.withColumn("run", run).join(tops, ["tree", "run"]).select(F.col("name").alias("tree"), "height", F.col("digest").alias("subroot"), "root", F.struct(F.col("idx").alias("at"), F.col("path").alias("runs")).alias("path")), "subtrees")

    paths = parent_paths(levels, subtrees)
    found = placed.withColumn("run", run).join(paths, ["tree", "run"])
    below = folded(F.col("path"), F.col("idx"), F.col("other"), F.lit(""))
    found = found.withColumn("below", below)
    found = found.withColumn("all", folded(F.col("rest.runs"), F.col("rest.at"), F.col("below.digest"), F.col("below.siblings")))
    digests = F.sha2("all.siblings", 256).alias("proof_sha256"), F.col("all.digest").alias("folded_root")
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", *digests, (F.col("all.digest") == F.col("root")).alias("verified"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(docs["doc_id"].cast("string")) % 3 == 0
    return manifest(docs, tampered, F.translate(docs["text"], UPPER, LOWER))


_FIELD = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f) for f in FIELDS[:-1]) + " || " + _FIELD + ")"
_BYTE = "CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"
_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: CAST(i AS BIGINT))), lambda x, i: " + _BYTE + "))"
#: Both walks go up as long as there is a run; the last step of each has the digest and the siblings so far.
_WALK = "SELECT w.{key}, w.tree, level + 1, pos // 8, sha256(array_to_string(members[1 : pos % 8], '') || folded || array_to_string(members[pos % 8 + 2 :], '')), siblings || array_to_string(members[1 : pos % 8], '') || array_to_string(members[pos % 8 + 2 :], '') FROM {w} w JOIN {runs} r ON r.tree = w.tree AND r.up = w.level AND r.run = w.pos // 8"
ORACLE_SQL = f"""WITH RECURSIVE d AS (SELECT *, row_number() OVER () AS k, xor({_CRC}, 4294967295) % 3 = 0 AS tampered FROM documents),
 l AS (SELECT k, doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS tree, {_LEAF.format("text")} AS leaf,
   CASE WHEN tampered THEN {_LEAF.format(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {_LEAF.format("text")} END AS other FROM d),
 p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM l),
 v AS (SELECT 0 AS level, tree, idx, n, leaf AS digest FROM p UNION ALL SELECT level + 1, tree, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM v WHERE n > 1 GROUP BY level, tree, idx // 8, n),
 runs AS (SELECT tree, level AS up, idx // 8 AS run, list(digest ORDER BY idx) AS members FROM v WHERE n > 1 GROUP BY ALL),
 s AS (SELECT tree AS name, '' AS tree, digest, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM v WHERE n = 1),
 t AS (SELECT 0 AS level, tree, idx, n, digest FROM s UNION ALL SELECT level + 1, tree, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM t WHERE n > 1 GROUP BY level, tree, idx // 8, n),
 tops AS (SELECT tree, level AS up, idx // 8 AS run, list(digest ORDER BY idx) AS members FROM t WHERE n > 1 GROUP BY ALL),
 w AS (SELECT k, tree, 0 AS level, idx AS pos, other AS folded, '' AS siblings FROM p UNION ALL {_WALK.format(key="k", w="w", runs="runs")}),
 x AS (SELECT k, '' AS tree, 0 AS level, s.idx AS pos, folded, siblings FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY level DESC) = 1) b JOIN s ON s.name = b.tree
   UNION ALL {_WALK.format(key="k", w="x", runs="tops")}),
 z AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY k ORDER BY level DESC) = 1)
SELECT doc_id, leaf, s.digest AS subroot, (SELECT digest FROM t WHERE n = 1) AS root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = (SELECT digest FROM t WHERE n = 1) AS verified
 FROM p JOIN z USING (k) JOIN s ON s.name = p.tree"""
