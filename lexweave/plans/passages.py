"""Phrases and changed quotes looked up in scanned contracts, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators import located, passages
from lexweave.plans import drafted, evidence
from lexweave.plans.rollups import table


def contract_tokens(spark: SparkSession, d: str, parts: int | None = None) -> DataFrame:
    """The tokens of documents laid out as contracts and scanned word by word, in ``parts`` partitions by document."""
    return located.positioned_tokens(drafted.scanned(evidence.numbered_pages(spark, d), parts=parts or drafted.parts(spark, d)))


def _boxes(boxes: Column) -> Column:
    corner = lambda b: F.concat_ws(":", b["page"], b["line"], *[b[c].cast("long") for c in located.BOX])
    return F.array_join(F.transform(boxes, corner), ";")


def phrase_passages(spark: SparkSession, d: str) -> DataFrame:
    """The first two words of each benchmark item as a phrase; words end at any white space, line breaks too."""
    words = F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")
    phrases = table(spark, d, "benchmark").select("item_id", F.array_join(F.slice(words, 1, 2), " ").alias("text"))
    found = passages.described_phrases(contract_tokens(spark, d), phrases, "item_id")
    return found.select("document", "item_id", F.col("hit").cast("long").alias("hit"), "total", "page", "clause", "text", "snippet", _boxes(F.col("boxes")).alias("boxes"))


def changed_lines(pages: DataFrame) -> DataFrame:
    """Every fifth line as a quote (document, quote_id, quote, page, page_end): as it is, or with its fourth word left
    out, or with two words more, or with every fourth word replaced; hints name the page, the one after, or none."""
    k = F.col("quote_id")
    lines = pages.select("document", F.posexplode(F.split("text", "\n")).alias("quote_id", "x")).where("quote_id % 5 = 1 AND x <> ''").withColumn("quote_id", k.cast("long"))
    words = F.split("x", " ")
    form, page = F.floor(k / 5) % 4, F.floor(k / drafted.PAGE) + 1
    quote = (
        F.when(form == 0, F.col("x"))
        .when(form == 1, F.array_join(F.concat(F.slice(words, 1, 3), F.slice(words, F.lit(5), F.size(words))), " "))
        .when(form == 2, F.concat(F.array_join(F.slice(words, 1, 5), " "), F.lit(" added here "), F.array_join(F.slice(words, F.lit(6), F.size(words)), " ")))
        .otherwise(F.array_join(F.transform(words, lambda w, i: F.when(i % 4 == 3, "changed").otherwise(w)), " "))
    )
    hint = F.when(F.col("document") % 5 == 0, None).otherwise(page + F.when(F.col("document") % 3 == 0, 1).otherwise(0))
    return lines.select("document", "quote_id", quote.alias("quote"), hint.alias("page"), hint.alias("page_end"))


def quote_hints(spark: SparkSession, d: str) -> DataFrame:
    """Changed lines looked up in the scans: verified where they stand as they are, hints where they are only alike."""
    parts = drafted.parts(spark, d)
    found = passages.described_quotes(contract_tokens(spark, d, parts), changed_lines(evidence.pages(spark, d)), parts=parts)
    return found.select("document", "quote_id", "verified", F.round("score", 4).alias("score"), "page", "clause", "text", _boxes(F.col("boxes")).alias("boxes"))


QUERIES = {f.__name__: f for f in (phrase_passages, quote_hints)}

_L = "l AS (SELECT document, line, text AS x FROM laid),"
ORACLE_SQL = {
    "phrase_passages": rf"""WITH {evidence.LAID}, {_L}{drafted.TOKENS},
      y AS (SELECT document, string_agg(norm, ' ' ORDER BY position) AS hay, count(*) AS n_tokens FROM t GROUP BY document),
      a AS (SELECT item_id, array_to_string(list_filter(list_transform(list_filter(regexp_split_to_array(text, '[\s\p{{Z}}\x85\x0b]+'), lambda v: v <> '')[1:2], lambda v: {drafted.norm("v")}), lambda v: v <> ''), ' ') AS needle FROM benchmark),
      c1 AS (SELECT document, item_id, hay, n_tokens, length(needle) AS size, string_split(hay, needle) AS parts FROM y JOIN a ON needle <> '' AND contains(hay, needle)),
      h1 AS (SELECT *, unnest(range(least(len(parts) - 1, 20))) AS hit FROM c1),
      h2 AS (SELECT *, CAST(list_sum(list_transform(parts[1 : hit + 1], lambda p: length(p))) + hit * size AS BIGINT) AS spot FROM h1),
      r AS (SELECT document, item_id, hit, len(parts) - 1 AS total, n_tokens, len(string_split(left(hay, spot), ' ')) - 1 AS first, len(string_split(left(hay, spot + size - 1), ' ')) - 1 AS last FROM h2),
      m AS (SELECT document, position AS spot, CASE WHEN regexp_matches(norm, '^\d{{1,2}}$') THEN '' ELSE norm END AS mark FROM t
        WHERE (last_line IS NULL OR last_line <> line) AND (regexp_matches(norm, '^\d{{1,2}}(\.\d{{1,3}}){{1,3}}$') OR regexp_matches(norm, '^\d{{1,2}}$') AND word LIKE '%.')),
      g AS (SELECT r.*, CASE WHEN first - m.spot < 600 THEN nullif(mark, '') END AS before FROM r ASOF LEFT JOIN m ON m.document = r.document AND m.spot <= r.first),
      i AS (SELECT g.document, item_id, hit, arg_min(mark, m.spot) AS inside FROM g JOIN m ON m.document = g.document AND mark <> '' AND m.spot BETWEEN first AND last GROUP BY ALL),
      z AS (SELECT r.document, item_id, hit, min(page) FILTER (WHERE position = first) AS page,
        string_agg(CASE WHEN head THEN word || ' ' || rest ELSE word END, ' ' ORDER BY position) FILTER (WHERE position BETWEEN first AND last) AS text,
        CASE WHEN any_value(first) > 12 THEN '… ' ELSE '' END || string_agg(CASE WHEN head THEN word || ' ' || rest ELSE word END, ' ' ORDER BY position) || CASE WHEN any_value(last) + 13 < any_value(n_tokens) THEN ' …' ELSE '' END AS snippet
        FROM r JOIN t ON t.document = r.document AND position BETWEEN first - 12 AND last + 12 GROUP BY r.document, item_id, hit),
      b1 AS (SELECT r.document, item_id, hit, page, unnest(CASE WHEN head THEN [line, rest_line] ELSE [line] END) AS line, unnest(CASE WHEN head THEN [i, rest_i] ELSE [i] END) AS i FROM r JOIN t ON t.document = r.document AND position BETWEEN first AND last),
      nth AS (SELECT document, page, line, dense_rank() OVER (PARTITION BY document, page ORDER BY line) - 1 AS nth FROM s GROUP BY document, page, line),
      b2 AS (SELECT document, item_id, hit, page, nth, concat_ws(':', page, nth, min(10 * i), 10 * line, max(10 * i + 9), 10 * line + 9) AS box FROM b1 JOIN nth USING (document, page, line) GROUP BY document, item_id, hit, page, line, nth),
      b3 AS (SELECT document, item_id, hit, string_agg(box, ';' ORDER BY page, nth) AS boxes FROM b2 GROUP BY ALL)
      SELECT g.document, g.item_id, g.hit, g.total, page, coalesce(before, inside) AS clause, text, snippet, boxes FROM g JOIN z USING (document, item_id, hit) JOIN b3 USING (document, item_id, hit) LEFT JOIN i USING (document, item_id, hit)""",
}
