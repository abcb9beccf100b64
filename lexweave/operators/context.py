"""Context for a question: scored passages, budgets, last messages, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sizes and budgets in characters, and numbers of messages and passages.
PASSAGE = 3500
PASSAGES = 80
PASSAGE_BUDGET = 60_000
FINDINGS_BUDGET = 30_000
HISTORY_BUDGET = 16_000
HISTORY = 12
KEPT_MESSAGES = 80


def short_stems(text: Column, least: int = 1) -> Column:
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[а-яёa-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= least)
    return F.array_distinct(F.transform(words, lambda w: F.left(w, F.lit(5))))


def passages(pages: DataFrame) -> DataFrame:
    """(document, page, part, content): pages cut into slices of one size."""
    parts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / PASSAGE).cast("int") - 1, F.lit(0)))
    cut = pages.where("text <> ''").select("document", "page", "text", F.explode(parts).alias("part"))
    return cut.select("document", "page", F.col("part").cast("long"), F.substring(F.col("text"), F.col("part") * PASSAGE + 1, F.lit(PASSAGE)).alias("content"))


def passage_scores(pages: DataFrame, questions: DataFrame) -> DataFrame:
    """(document, question, page, part, score, content): shared stems, with the selected and named pages first.

    ``questions`` has document, question, text and selected_page.
    """
    named = F.transform(F.regexp_extract_all(F.lower("text"), F.lit(r"(?:стр(?:аниц[аеуы]?)?\.?|page)\s*(\d+)"), F.lit(1)), lambda n: n.try_cast("bigint"))
    asked = questions.select("document", "question", "selected_page", short_stems(F.col("text"), 3).alias("stems"), named.alias("named"))
    both = passages(pages).join(asked, "document")
    score = F.size(F.array_intersect(short_stems(F.col("content")), F.col("stems"))) + F.when(F.col("page") == F.col("selected_page"), 1000).otherwise(0) + F.when(F.array_contains("named", F.col("page")), 500).otherwise(0)
    return both.select("document", "question", "page", "part", score.cast("long").alias("score"), "content")


def budgeted_passages(scored: DataFrame, budget: int = PASSAGE_BUDGET, most: int = PASSAGES) -> DataFrame:
    """The best passages while the budget lasts; the one at the edge is cut."""
    best = Window.partitionBy("document", "question").orderBy(F.desc("score"), "page", "part")
    top = scored.withColumn("n", F.row_number().over(best)).where(F.col("n") <= most)
    before = F.coalesce(F.sum(F.length("content")).over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = top.withColumn("before", before).where(F.col("before") < budget)
    return kept.select("document", "question", "page", "part", "score", F.left("content", (F.lit(budget) - F.col("before")).cast("int")).alias("content"))


def last_messages(messages: DataFrame, by: str, order: list[str], n: int = KEPT_MESSAGES) -> DataFrame:
    """The newest ``n`` rows of each key, numbered from the oldest kept."""
    newest = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    kept = messages.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n).drop("_n")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long"))


def fitting(rows: DataFrame, by: str, order: list[str], size: str, budget: int, most: int | None = None) -> DataFrame:
    """Rows taken in order while they fit; one too large is skipped and later ones may fit.

    What fits depends on all that was taken before, so a key's sizes are folded in order; only sizes and places are
    gathered, and keys are conversations or documents, which are small. Equal rows are rows of their own, a row without
    a size takes no room, and rows without a key are one key.
    """
    others = [c for c in rows.columns if c not in (by, *order)]
    placed = rows.withColumn("_place", F.row_number().over(Window.partitionBy(by).orderBy(*order, *others)))
    in_order = F.array_sort(F.collect_list(F.struct("_place", F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_size"))))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("taken"))

    def step(acc: Column, row: Column) -> Column:
        fits = row["_size"] <= acc["left"]
        if most is not None:
            fits = fits & (acc["n"] < most)
        taken = F.when(fits, F.array_append(acc["taken"], row["_place"])).otherwise(acc["taken"])
        return F.struct((acc["left"] - F.when(fits, row["_size"]).otherwise(0)).alias("left"), (acc["n"] + fits.cast("int")).alias("n"), taken.alias("taken"))

    folded = placed.groupBy(by).agg(in_order.alias("rows")).withColumn("taken", F.aggregate("rows", start, step, lambda acc: acc["taken"]))
    kept = folded.select(F.col(by).alias("_by"), F.explode("taken").alias("_taken"))
    return placed.join(kept, placed[by].eqNullSafe(kept["_by"]) & (placed["_place"] == kept["_taken"]), "left_semi").drop("_place")


def fingerprint(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(by, fingerprint): digest of a key's rows, sorted, as JSON with its nulls."""
    packed = F.to_json(F.array_sort(F.collect_list(F.struct(*columns))), {"ignoreNullFields": "false"})
    return rows.groupBy(by).agg(F.sha2(packed, 256).alias("fingerprint"))


def fragments(chunks: DataFrame, by: str, order: str) -> DataFrame:
    """(by, fragments): a rule's chunks as numbered blocks with their pages and title."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(order))
    pages = F.when(F.col("page") == F.col("page_end"), F.concat(F.lit("стр. "), F.col("page"))).otherwise(F.concat(F.lit("стр. "), F.col("page"), F.lit("–"), F.col("page_end")))
    block = F.concat(F.lit("[F"), place, F.lit("] ("), F.concat_ws(", ", pages, F.col("title")), F.lit(")\n"), F.col("content"))
    numbered = chunks.select(by, place.alias("n"), block.alias("block"))
    return numbered.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "block"))), lambda r: r["block"]), "\n\n").alias("fragments"))
