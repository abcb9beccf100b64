"""Phrases and quotes looked up in positioned tokens, with page, clause, snippet and boxes of what is found.

Tokens are rows of ``positioned_tokens`` or documents of ``gathered``; the former are gathered first, by a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type

from lexweave.operators.columns import let
from lexweave.operators.located import BOX, gathered
from lexweave.operators.quotes import BACK, FUZZY, PHRASES, automaton_of, best_stretch, needle_starts, needles_in_blocks, normal_tokens

#: Tokens of a snippet before and after what it shows.
AROUND = 12


def _documents(tokens: DataFrame) -> DataFrame:
    return tokens if "t" in tokens.columns else gathered(tokens)


def _among(first: Column, last: Column) -> Column:
    """The tokens of these positions; only they are touched."""
    return F.transform(F.sequence(first, last), lambda i: F.get("t", i))


def _joined(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda w: w["norm"]), " ")


def _asked_phrases(docs: DataFrame, phrases: DataFrame, phrase: str, limit: int, block: int) -> Iterator[DataFrame]:
    """``docs`` with ``asked``, the places of phrases of one block in a document: (phrase, hit, total, first, last)."""
    whole = pa.int64()
    spans = pa.list_(pa.struct([(phrase, to_arrow_type(phrases.schema[phrase].dataType)), ("hit", pa.int32()), ("total", whole), ("first", whole), ("last", whole)]))

    def searching(sent: Broadcast) -> Callable[[pa.Array, pa.Array], pa.Array]:
        def search(hays: pa.Array, lengths: pa.Array) -> pa.Array:
            found: list[list[tuple]] = []
            automaton = automaton_of(tuple(sent.value)) if sent.value else None
            for hay, sizes in zip(hays.to_pylist(), lengths, strict=True):
                found.append([])
                starts = needle_starts(automaton, hay) if automaton and hay else ()
                # where a token begins is a running sum; a place lies in the last token that begins at or before it
                ends = np.cumsum(sizes.values.to_numpy() + 1) if starts else None
                for needle, own in starts:
                    at = np.array(own[:limit])
                    first, last = (np.searchsorted(ends, x, "right").tolist() for x in (at, at + len(needle) - 1))
                    found[-1].extend((p, hit, len(own), a, z) for p in sent.value[needle] for hit, (a, z) in enumerate(zip(first, last, strict=True)))
            return pa.array(found, spans)

        return search

    for sent in needles_in_blocks(phrases, phrase, block):
        # what Spark takes for another result each time is not computed twice
        places = F.arrow_udf(searching(sent), from_arrow_type(spans)).asNondeterministic()
        yield docs.withColumn("asked", places(_joined(F.col("t")), F.transform("t", lambda w: F.length(w["norm"]))))


def found_phrases(tokens: DataFrame, phrases: DataFrame, phrase: str, limit: int = 20, block: int = PHRASES) -> DataFrame:
    """(document, phrase, hit, total, first, last): the first ``limit`` places of a phrase in a document's tokens, inside
    longer words too, numbered from 0, with the positions of the first and last token that it touches, and the number of
    all places. ``phrases`` has the phrase's id and ``text``; it is the query set of ``phrase_hits``."""
    each = [docs.select("document", F.explode("asked").alias("a")).select("document", "a.*") for docs in _asked_phrases(_documents(tokens), phrases, phrase, limit, block)]
    return reduce(DataFrame.unionByName, each)


def described_phrases(tokens: DataFrame, phrases: DataFrame, phrase: str, limit: int = 20, around: int = AROUND, block: int = PHRASES) -> DataFrame:
    """``found_phrases`` with page, clause, text, snippet and boxes as in ``described``. All of it is made where a document
    is searched, so no token is shuffled for it."""
    return reduce(DataFrame.unionByName, [_shown(docs, around) for docs in _asked_phrases(_documents(tokens), phrases, phrase, limit, block)])


def _pages() -> Column:
    """The pages of a document as (page, hay, base): the normal forms of their tokens with spaces between, and the first position."""
    n, page = F.size("t"), lambda i: F.get("t", i)["page"]
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (page(i) != page(i - 1)))
    own = lambda starts, at, k: _among(at, F.coalesce(F.get(starts, k + 1), n) - 1)
    return let(starts, lambda s: F.transform(s, lambda at, k: F.struct(page(at).alias("page"), _joined(own(s, at, k)).alias("hay"), at.cast("long").alias("base"))))


def _asked_quotes(docs: DataFrame, quotes: DataFrame, least: float, parts: int | None = None) -> DataFrame:
    """``docs`` with ``asked``, what ``hinted_quotes`` finds in a document: (quote_id, verified, first, last, score).

    The quotes of a document are one row and meet its tokens there.
    """
    words = normal_tokens(F.col("quote"))
    each = quotes.select("document", "quote_id", (F.col("page") - 1).alias("low"), (F.col("page_end") + 1).alias("high"), words.alias("words")).where(F.size("words") > 0)
    each = each.repartition(parts, "document") if parts else each
    whole = each.groupBy("document").agg(F.collect_list(F.struct("quote_id", "low", "high", "words")).alias("quotes"))
    spaced = lambda words: F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    lined = lambda words: F.concat(F.lit("\n"), F.array_join(words, "\n"), F.lit("\n"))

    def hinted(a: Column, pages: Column) -> Column:
        # the pages of the hint and their neighbours as one text, null without a hint or such pages
        own = F.filter(pages, lambda p: (p["page"] >= a["low"]) & (p["page"] <= a["high"]))
        hay = lambda own: F.when(F.size(own) > 0, F.array_join(F.transform(own, lambda p: p["hay"]), " "))
        scope = lambda own: F.struct(hay(own).alias("hay"), F.get(own, F.lit(0))["base"].alias("base"))
        at = lambda s: F.instr(F.concat(F.lit(" "), s["hay"], F.lit(" ")), spaced(a["words"]))
        return let(let(own, scope), lambda s: F.struct(*[a[c].alias(c) for c in ("quote_id", "words")], s["hay"].alias("hay"), s["base"].alias("base"), F.coalesce(at(s), F.lit(0)).alias("at")))

    spans = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))

    def liken(asked: pa.Array) -> pa.Array:
        def alike(q: str, hay: str | None, base: int | None) -> tuple[int, int, float] | None:
            found = best_stretch(q, hay, least) if hay else None
            return found and (base + hay.count(" ", 0, found[0]), base + hay.count(" ", 0, found[1] - 1), found[2])

        return pa.array([[alike(**a) for a in own] for own in asked.to_pylist()], spans)

    scoped = docs.join(whole.hint("shuffle_hash"), "document").withColumn("quotes", let(_pages(), lambda pages: F.transform("quotes", lambda a: hinted(a, pages))))
    open_ = F.transform("quotes", lambda a: F.struct(F.array_join(a["words"], " ").alias("q"), F.when(a["at"] == 0, a["hay"]).alias("hay"), a["base"].alias("base")))
    likened = scoped.withColumn("alike", F.arrow_udf(liken, from_arrow_type(spans)).asNondeterministic()(open_))

    def told(a: Column, k: Column, line: Column) -> Column:
        span = lambda verified, first, last, score: F.struct(a["quote_id"].alias("quote_id"), F.lit(verified).alias("verified"), first.cast("long").alias("first"), last.cast("long").alias("last"), score.alias("score"))
        whole = lambda first: span(True, first, first + F.size(a["words"]) - 1, F.lit(100.0))
        near = F.get("alike", k)
        exact = a["base"] + F.size(F.split(F.left(a["hay"], a["at"] - 1), " ")) - 1
        # a line break stands before each token
        before = F.left(line, F.instr(line, lined(a["words"])))
        far = let(before, lambda b: F.when(b != "", whole(F.length(b) - F.length(F.replace(b, F.lit("\n"), F.lit(""))) - 1)))
        return F.when(a["at"] > 0, whole(exact)).when(near.isNotNull(), span(False, near["first"], near["last"], near["score"])).otherwise(far)

    every = let(lined(F.transform("t", lambda w: w["norm"])), lambda line: F.transform("quotes", lambda a, k: told(a, k, line)))
    return likened.select("document", "t", F.filter(every, lambda a: a.isNotNull()).alias("asked"))


def hinted_quotes(tokens: DataFrame, quotes: DataFrame, least: float = FUZZY) -> DataFrame:
    """(document, quote_id, verified, first, last, score): where quotes stand in a document's tokens.

    ``quotes`` has document, quote_id, quote, page and page_end; the last two are a hint, or null. The pages of the hint
    and their neighbours are searched for the quote's tokens, then for the stretch most like it, if it reaches ``least``
    of 100; after that the whole document, for the tokens only. What is merely alike is never verified. Quotes without a
    token and quotes that are not found have no row; a hint of pages that the document does not have is no hint.
    """
    asked = _asked_quotes(_documents(tokens), quotes, least)
    return asked.select("document", F.explode("asked").alias("a")).select("document", "a.*")


def described_quotes(tokens: DataFrame, quotes: DataFrame, least: float = FUZZY, around: int = AROUND, parts: int | None = None) -> DataFrame:
    """``hinted_quotes`` with page, clause, text, snippet and boxes as in ``described``, made where a document is searched:
    what is found is not shuffled, nor sent to the driver. If the tokens lie in ``parts`` partitions by document, the
    quotes go there and the tokens stay."""
    return _shown(_asked_quotes(_documents(tokens), quotes, least, parts), around)


def described(spans: DataFrame, tokens: DataFrame, around: int = AROUND) -> DataFrame:
    """``spans`` (document, quote_id, first, last, ...) with page, clause, text, snippet and boxes.

    ``page`` is that of the first token, ``text`` the words as written, ``snippet`` the same with ``around`` tokens before
    and after and dots where the document goes on; ``boxes`` are sorted by page and line. ``clause`` is that of
    ``clause_of_quotes``. The spans of a document are one row and meet its tokens there; none is sent to the driver.
    """
    whole = spans.groupBy("document").agg(F.collect_list(F.struct(*[c for c in spans.columns if c != "document"])).alias("asked"))
    return _shown(_documents(tokens).join(whole.hint("shuffle_hash"), "document"), around)


def _shown(docs: DataFrame, around: int) -> DataFrame:
    """What ``described`` says of the spans ``asked`` in the documents (document, t, asked)."""
    n = F.size("t")
    spoken = lambda tokens: F.array_join(F.flatten(F.transform(tokens, lambda w: w["words"])), " ")
    dots = lambda going_on, text: F.when(going_on, text).otherwise("")

    def told(a: Column) -> Column:
        low, high = F.greatest(a["first"] - around, F.lit(0)), F.least(a["last"] + around, n - 1)
        head = F.get("t", a["first"])
        snippet = F.concat(dots(low > 0, F.lit("… ")), spoken(_among(low, high)), dots(high < n - 1, F.lit(" …")))
        before = F.when(a["first"] - head["at"] < BACK, F.nullif(head["mark"], F.lit("")))
        own = [a[c].alias(c) for c in docs.schema["asked"].dataType.elementType.names]

        def of(inside: Column) -> Column:
            begun = F.get(F.filter(inside, lambda w, i: (w["at"] == a["first"] + i) & (w["mark"] != "")), F.lit(0))
            return F.struct(*own, head["page"].alias("page"), F.coalesce(before, begun["mark"]).alias("clause"), spoken(inside).alias("text"), snippet.alias("snippet"), _lined(inside).alias("boxes"))

        return let(_among(a["first"], a["last"]), of)

    return docs.select("document", F.explode(F.transform("asked", told)).alias("s")).select("document", "s.*")


def _lined(tokens: Column) -> Column:
    """The boxes around the words of each line, sorted by page and line."""
    every = F.flatten(F.transform(tokens, lambda w: F.transform(w["boxes"], lambda b: F.struct(w["page"].alias("page"), *[b[c].alias(c) for c in ("line", *BOX)]))))
    line = lambda b: F.struct(b["page"].alias("page"), b["line"].alias("line"))

    def around(key: Column, boxes: Column) -> Column:
        corner = lambda c, most: most(F.transform(boxes, lambda b: b[c])).alias(c)
        return F.struct(key["page"].alias("page"), key["line"].alias("line"), *[corner(c, F.array_min) for c in BOX[:2]], *[corner(c, F.array_max) for c in BOX[2:]])

    lined = lambda boxes: F.transform(F.array_sort(F.array_distinct(F.transform(boxes, line))), lambda k: let(F.filter(boxes, lambda b: line(b).eqNullSafe(k)), lambda own: around(k, own)))
    return let(every, lined)
