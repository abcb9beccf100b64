"""Positioned words: pages laid out from them, tokens, where quotes stand in them, and the boxes to highlight."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.operators.columns import let
from lexweave.operators.quotes import clause_mark, has_norm, normal_token, normal_tokens
from lexweave.operators.structure import cleaned

BOX = ("x0", "y0", "x1", "y1")


def laid_out_words(scanned: DataFrame, digits: int | None = 1, dealt: bool = False) -> DataFrame:
    """(document, page, at, word, line, x0, y0, x1, y1) from the words of a page scan.

    ``scanned`` has document, page, seq (reading order), word, block, line and a box. Words are cleaned, empty ones go,
    boxes are rounded to one decimal (None: not yet), and lines are numbered from 0 in the order in which a page first shows them.
    With ``dealt`` the words were made from rows that are partitioned by document, and stay where they are.
    """
    # all that follows is within a document, so its words are shuffled once
    solid = scanned.withColumn("word", F.btrim(cleaned(F.col("word")), F.lit(" \n\r"))).where("word <> ''")
    solid = solid if dealt else solid.repartition("document")
    page = Window.partitionBy("document", "page")
    seen = F.min("seq").over(Window.partitionBy("document", "page", "block", "line"))
    lined = solid.withColumn("seen", seen).withColumn("line", F.dense_rank().over(page.orderBy("seen")) - 1)
    at = F.row_number().over(page.orderBy("seq")) - 1
    return lined.select("document", "page", at.alias("at"), "word", "line", *[c if digits is None else F.round(c, digits).alias(c) for c in BOX])


def page_texts(words: DataFrame) -> DataFrame:
    """(document, page, text): the words of a page with a line break wherever the line changes."""
    before = F.lag("line").over(Window.partitionBy("document", "page").orderBy("at"))
    gap = F.when(before.isNull(), "").when(before == F.col("line"), " ").otherwise("\n")
    pieces = words.select("document", "page", "at", F.concat(gap, "word").alias("piece"))
    joined = F.array_sort(F.collect_list(F.struct("at", "piece")))
    return pieces.groupBy("document", "page").agg(F.array_join(F.transform(joined, lambda p: p["piece"]), "").alias("text"))


def positioned_tokens(words: DataFrame) -> DataFrame:
    """(document, position, page, token, norm, starts_line, boxes, words) of the words of ``laid_out_words``.

    A word of three characters and more that ends in a hyphen is one token with a next word in lower case on another
    line. A word that such a token took up starts no other, so of a run of cut words every second one does. Tokens
    without a normal form are left out, and ``position`` numbers the rest through all pages of a document.
    """
    page = Window.partitionBy("document", "page").orderBy("at")
    cut = F.endswith("word", F.lit("-")) & (F.length("word") > 2) & (F.lead("line").over(page) != F.col("line")) & F.lead("word").over(page).rlike(r"^\p{Ll}")
    own = F.struct("line", *BOX)
    seen = words.select(
        "*",
        F.coalesce(cut, F.lit(False)).alias("cut"),
        own.alias("own"),
        F.lead(own).over(page).alias("next"),
        F.lead("word").over(page).alias("rest"),
        (~F.lag("line").over(page).eqNullSafe(F.col("line"))).alias("starts_line"),
    )
    # of a run of cut words every second one starts no token: they are counted from the last word that is not cut
    whole = F.max(F.when(~F.col("cut"), F.col("at"))).over(page.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    nth = F.col("at") - F.coalesce(whole, F.lit(-1))
    heads = seen.withColumn("head", F.col("cut") & (nth % 2 == 1))
    taken = heads.withColumn("taken", F.coalesce(F.lag("head").over(page), F.lit(False))).where("NOT taken")
    token = F.when(F.col("head"), F.concat(F.substring("word", F.lit(1), F.length("word") - 1), "rest")).otherwise(F.col("word"))
    boxes = F.when(F.col("head"), F.array("own", "next")).otherwise(F.array("own"))
    written = F.when(F.col("head"), F.array("word", "rest")).otherwise(F.array("word"))
    tokens = taken.select("document", "page", "at", token.alias("token"), "starts_line", boxes.alias("boxes"), written.alias("words")).where(has_norm(F.col("token"))).withColumn("norm", normal_token(F.col("token")))
    position = F.row_number().over(Window.partitionBy("document").orderBy("page", "at")) - 1
    return tokens.select("document", position.alias("position"), "page", "token", "norm", "starts_line", "boxes", "words")


def gathered(tokens: DataFrame) -> DataFrame:
    """(document, t): the tokens of a document as one row, which needs no shuffle right after ``positioned_tokens``.

    ``t`` holds page, norm, boxes and words in the order of the positions, which number it from 0, and the last number of a
    clause ('' for a section) that began a line so far as ``mark``, with its position ``at``.
    """
    mark = F.when(F.col("starts_line"), clause_mark(F.col("token"), F.col("norm")))
    so_far = Window.partitionBy("document").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = tokens.withColumn("told", F.last(F.when(mark.isNotNull(), F.struct(F.col("position").cast("long").alias("at"), mark.alias("mark"))), True).over(so_far))
    row = F.struct("position", "page", "norm", "boxes", "words", "told.at", "told.mark")
    whole = marked.groupBy("document").agg(F.sort_array(F.collect_list(row)).alias("t"))
    return whole.select("document", F.transform("t", lambda w: w.dropFields("position")).alias("t"))


def _found(tokens: DataFrame, quotes: DataFrame, *more: str) -> DataFrame:
    """(document, quote_id, first, last, span): the first place where all tokens of a quote stand one after the other, with
    ``more`` columns of its tokens. The tokens of a document are one row, and so are its quotes: none is repeated for another."""
    line = lambda norms: F.concat(F.lit("\n"), F.array_join(norms, "\n"), F.lit("\n"))
    in_order = F.sort_array(F.collect_list(F.struct("position", "norm", *more)))
    hay = tokens.groupBy("document").agg(in_order.alias("t")).withColumn("hay", line(F.transform("t", lambda t: t["norm"])))
    asked = quotes.select("document", "quote_id", normal_tokens(F.col("quote")).alias("q")).where(F.size("q") > 0)
    whole = asked.groupBy("document").agg(F.collect_list(F.struct("quote_id", F.size("q").alias("n"), line(F.col("q")).alias("q"))).alias("asked"))
    stands = lambda q: F.struct(q["quote_id"].alias("quote_id"), q["n"].alias("n"), F.left("hay", F.instr("hay", q["q"])).alias("before"))
    # a line break stands before each token
    first = lambda f: F.length(f["before"]) - F.length(F.replace(f["before"], F.lit("\n"), F.lit(""))) - 1
    span = lambda f, k: F.struct(f["quote_id"].alias("quote_id"), k.alias("first"), (k + f["n"] - 1).alias("last"), F.slice("t", k + 1, f["n"]).alias("span"))
    found = F.transform(F.filter(F.transform("asked", stands), lambda f: f["before"] != ""), lambda f: let(first(f), lambda k: span(f, k)))
    return hay.join(whole.hint("shuffle_hash"), "document").select("document", F.explode(found).alias("f")).select("document", "f.*")


def located_quotes(tokens: DataFrame, quotes: DataFrame) -> DataFrame:
    """(document, quote_id, first, last): the first positions where all tokens of a quote stand one after the other.

    Quotes without a token and quotes that stand nowhere have no row.
    """
    return _found(tokens, quotes).select("document", "quote_id", "first", "last")


def boxes_of_quotes(tokens: DataFrame, quotes: DataFrame) -> DataFrame:
    """``quote_boxes`` of ``located_quotes``: the tokens are read once, and a quote takes its boxes where it is found. Boxes
    are rounded here, which gives the same as rounding those of all words before."""
    words = _found(tokens, quotes, "page", "boxes").select("document", "quote_id", F.explode("span").alias("w"))
    found = _boxes(words.select("document", "quote_id", "w.page", F.explode("w.boxes").alias("b")))
    return found.select("document", "quote_id", "page", "line", *[F.round(c, 1).alias(c) for c in BOX])


def quote_boxes(found: DataFrame, tokens: DataFrame) -> DataFrame:
    """(document, quote_id, page, line, x0, y0, x1, y1): one box around the words of a located quote on each line."""
    spans = found.select("document", "quote_id", F.explode(F.sequence("first", "last")).alias("position"))
    words = spans.join(tokens.select("document", "position", "page", "boxes"), ["document", "position"]).select("document", "quote_id", "page", F.explode("boxes").alias("b"))
    return _boxes(words)


def _boxes(words: DataFrame) -> DataFrame:
    corners = [F.min("b.x0").alias("x0"), F.min("b.y0").alias("y0"), F.max("b.x1").alias("x1"), F.max("b.y1").alias("y1")]
    return words.groupBy("document", "quote_id", "page", F.col("b.line").alias("line")).agg(*corners)
