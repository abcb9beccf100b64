"""Evidence queries over the driver's tables: documents are pages of text, benchmark items are rules' questions,
embeddings are the vectors of both, conversations are chat histories."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.operators import context, dedup, drafts, evaluate, findings, quotes, reports, retrieval, structure, worklists
from lexweave.plans.rollups import table
from lexweave.plans.session import shared_dir, staged
from lexweave.streaming import feeds


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("document"), F.lit(1).cast("long").alias("page"), "text")


def numbered_pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents laid out as contracts: every sixth line becomes a section heading, every third a clause."""
    lines = F.split("text", "\n")
    title = lambda x: F.array_join(F.slice(F.split(x, " "), 1, 3), " ")

    def laid_out(x: Column, i: Column) -> Column:
        section, clause = (F.floor(i / 6) % 90 + 1).cast("string"), (F.floor(i % 6 / 3) + 1).cast("string")
        return F.when(i % 6 == 0, F.concat(section, F.lit(". "), title(x))).when(i % 3 == 0, F.concat(section, F.lit("."), clause, F.lit(" "), x)).otherwise(x)

    return pages(spark, d).select("document", "page", F.array_join(F.transform(lines, laid_out), "\n").alias("text"))


LAID = """
raw AS (SELECT doc_id AS document, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents WHERE text IS NOT NULL),
laid AS (SELECT document, line, CASE WHEN line % 6 = 0 THEN CAST(line // 6 % 90 + 1 AS VARCHAR) || '. ' || array_to_string(string_split(x, ' ')[1:3], ' ')
  WHEN line % 3 = 0 THEN CAST(line // 6 % 90 + 1 AS VARCHAR) || '.' || CAST(line % 6 // 3 + 1 AS VARCHAR) || ' ' || x ELSE x END AS text FROM raw)"""
LINES = LAID + """,
lines AS (SELECT * FROM laid WHERE trim(regexp_replace(text, '\\s', ' ', 'g')) <> ''),
shaped AS (SELECT *, nullif(regexp_extract(text, '^\\s*(\\d{1,2}(?:\\.\\d{1,3}){1,3})\\.?\\s+(\\S.*)$', 1), '') AS clause,
  regexp_matches(text, '(?i)^\\s*(?:(?:раздел|статья|глава)\\s+)?(\\d{1,2}|[IVXLC]{1,6})\\.?\\s+([\\p{L}][^\\n]{2,120})$') AS shape,
  trim(regexp_extract(text, '(?i)^\\s*(?:(?:раздел|статья|глава)\\s+)?(\\d{1,2}|[IVXLC]{1,6})\\.?\\s+([\\p{L}][^\\n]{2,120})$', 2)) AS title,
  regexp_extract(text, '(?i)^\\s*(?:(?:раздел|статья|глава)\\s+)?(\\d{1,2}|[IVXLC]{1,6})\\.?\\s+([\\p{L}][^\\n]{2,120})$', 1) AS num FROM lines),
judged AS (SELECT *, clause IS NULL AND shape AND len(regexp_extract_all(title, '\\p{L}')) >= 4 AND NOT regexp_matches(title, '[,;]$')
  AND (len(regexp_extract_all(title, '\\p{Lu}')) > 0.7 * len(regexp_extract_all(title, '\\p{L}'))
    OR (length(title) <= 60 AND len(regexp_split_to_array(title, '\\s+')) <= 6 AND regexp_matches(title, '^\\p{Lu}') AND NOT ends_with(title, '.'))) AS head FROM shaped),
named AS (SELECT *, CASE WHEN head THEN num || '. ' || CASE WHEN NOT regexp_matches(title, '\\p{Ll}') AND regexp_matches(title, '\\p{Lu}')
    THEN upper(left(regexp_replace(title, '\\.+$', ''), 1)) || lower(substr(regexp_replace(title, '\\.+$', ''), 2)) ELSE regexp_replace(title, '\\.+$', '') END END AS heading FROM judged),
carried AS (SELECT *, last_value(heading IGNORE NULLS) OVER w AS section,
  sum(CASE WHEN clause IS NOT NULL OR heading IS NOT NULL OR line = first_line THEN 1 ELSE 0 END) OVER w AS segment
  FROM (SELECT *, min(line) OVER (PARTITION BY document) AS first_line FROM named) WINDOW w AS (PARTITION BY document ORDER BY line ROWS UNBOUNDED PRECEDING))""".replace("\\\\", "\\")


def carry_section(spark: SparkSession, d: str) -> DataFrame:
    return structure.marked_lines(structure.lines_of(numbered_pages(spark, d))).select("document", "line", "clause", "section", "segment")


def line_segments(spark: SparkSession, d: str) -> DataFrame:
    return structure.segments(structure.lines_of(numbered_pages(spark, d))).select("document", "segment", "clause", "section", "text")


def outline_sections(spark: SparkSession, d: str) -> DataFrame:
    found = structure.outline(structure.segments(structure.lines_of(numbered_pages(spark, d))))
    return found.select("document", "section", "page", F.size("clauses").cast("long").alias("n"), F.array_join(F.transform("clauses", lambda c: c["clause"]), ",").alias("clauses"))


def page_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return structure.page_paragraphs(structure.lines_of(numbered_pages(spark, d)))


def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    return structure.chunks(structure.segments(structure.lines_of(numbered_pages(spark, d))))


def law_count(spark: SparkSession, d: str) -> DataFrame:
    """Documents name no law, so the language of a text stands for what it cites."""
    cited = F.concat("text", F.when(F.col("lang") == "en", " 44-ФЗ").when(F.col("lang") == "de", " 223 - фз, № 44").otherwise(""))
    return table(spark, d, "documents").select("doc_id", structure.law_type(cited).alias("law"))


def lexical_rank(spark: SparkSession, d: str) -> DataFrame:
    """Twelve best documents for each benchmark item; the number is the feature."""
    ranks = retrieval.lexical_ranks(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "doc_id", retrieval.candidates_for(retrieval.TOP_K))
    return ranks.select("item_id", "doc_id", "rank_value", F.col("lexical_rank").cast("long"))


def _vector_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every row whose id is divisible by 20 asks, against all rows."""
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select((F.col("vec_id") / 20).cast("long").alias("item_id"), "embedding")


def vector_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    ranks = retrieval.vector_ranks(_vector_queries(spark, d), rows, "item_id", "doc_id", 12, cutoff=0.8)
    return ranks.select("item_id", "doc_id", F.round("distance", 6).alias("distance"), F.col("vector_rank").cast("long"))


def fused(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.fused(vector_rank(spark, d), lexical_rank(spark, d), "item_id", "doc_id", 12)


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fused(spark, d).select("item_id", "doc_id", F.round("score", 9).alias("score"), "fts_hit", F.col("place").cast("long"))


def mmr_select(spark: SparkSession, d: str) -> DataFrame:
    found = fused(spark, d)
    texts = table(spark, d, "documents").join(found.select("doc_id"), "doc_id", "left_semi")
    candidates = found.join(retrieval.hash_embeddings(texts, "doc_id", "text"), "doc_id", "left").withColumn("content", F.lit(""))
    return retrieval.in_document_order(retrieval.mmr(candidates, "item_id", "doc_id"), "item_id", "doc_id")


def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.hash_embeddings(table(spark, d, "documents"), "doc_id", "text")


def rule_cache_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", retrieval.cache_key(F.lit("local-hash"), F.col("text")).alias("key"))


def stem_sets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(retrieval.stems(F.col("text"))).alias("stem")).groupBy("stem").agg(F.count("*").alias("n"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line").cast("long"))


def noise_filter(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("doc_id", "line", evaluate.is_noise(F.col("text")).alias("noise"))


def heading_filter(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("doc_id", "line", evaluate.is_heading_quote(F.col("text")).alias("heading"))


def _rules(spark: SparkSession, d: str) -> DataFrame:
    k, none = F.col("item_id"), F.lit(None).cast("string")
    severity = F.when(k % 4 == 0, "RED").when(k % 4 == 1, "LOW").otherwise("YELLOW")
    marker = F.when(k % 2 == 0, F.concat(F.lit("(?iU)\\b"), F.substring_index("text", " ", 1), F.lit("\\b")))
    return table(spark, d, "benchmark").select(k.alias("rule"), severity.alias("severity"), F.concat(F.lit("Rule "), k).alias("title"), F.lit("Text").alias("description"), F.col("text").alias("query"), F.lit("Рекомендация: проверить").alias("prompt"), marker.alias("marker"), none.alias("exception"), none.alias("guard"))


def keyword_evaluate(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    contexts = lexical_rank(spark, d).join(chunks, "doc_id").select(F.col("doc_id").alias("document"), F.col("item_id").alias("rule"), F.lit(0).cast("long").alias("chunk"), "content", F.col("rank_value").alias("score"), F.lit(True).alias("fts_hit"))
    return evaluate.guarded(evaluate.keyword_findings(contexts, _rules(spark, d)))


def phrase_search_count(spark: SparkSession, d: str) -> DataFrame:
    hits = quotes.phrase_hits(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id")
    return hits.select("doc_id", "item_id", "total", F.element_at("positions", 1).alias("first"))


def quote_verification(spark: SparkSession, d: str) -> DataFrame:
    """Each document's second line as a quote: as it is, with its first digit changed, with its second half cited
    without a negation that stands before it in the document, and looked for on the wrong page (that of its first line)."""
    lines = F.split("text", "\n")
    second = F.try_element_at(lines, F.lit(2))
    half = F.array_join(F.slice(F.split(second, " "), F.floor(F.size(F.split(second, " ")) / 2).cast("int") + 1, F.lit(1000)), " ")
    digit = F.regexp_replace(F.concat(F.lit("7 "), second), r"^7", "8")
    denied = F.concat_ws(" ", "text", F.lit("не"), half)
    forms = [("as it is", second, F.col("text"), F.col("text")), ("digit", digit, F.concat(F.lit("7 "), second), F.col("text")), ("negation", F.concat_ws(" ", half, F.lit("end")), F.concat(denied, F.lit(" end")), F.concat(denied, F.lit(" end"))), ("page", second, F.col("text"), F.element_at(lines, 1))]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("form"), q.alias("quote"), f.alias("fragment"), p.alias("page_text")) for k, q, f, p in forms])).alias("e")
    rows = table(spark, d, "documents").where(second != "").select("doc_id", each).select("doc_id", "e.*")
    return quotes.verify_quotes(rows).select("doc_id", "form", "verified")


def _drafts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("line")
    severity = F.when(k % 4 == 0, "RED").when(k % 4 == 1, "YELLOW").when(k % 4 == 2, "LOW").otherwise("GREEN")
    clause = F.when(k % 3 == 0, F.concat(F.lit("п. "), (k % 5).cast("string"), F.when(k % 2 == 0, ".1").otherwise("")))
    return _lines(spark, d).select(F.col("doc_id").alias("document"), k.alias("seq"), severity.alias("severity"), F.concat(F.lit("Rule "), k % 7).alias("title"), F.lit(None).cast("string").alias("reference"), F.concat(F.lit("Line "), k).alias("comment"), F.when(k % 2 == 0, F.concat(F.lit("Change "), k % 3)).alias("proposal"), F.when(k % 5 > 0, k % 4).alias("page"), clause.alias("clause"), F.col("text").alias("quote"), F.array(F.concat(F.lit("b"), k)).alias("boxes"), (k % 2 == 0).alias("verified"), ((k % 10) / 10).alias("confidence"))


def duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dedup.pairs_of(staged(dedup.keyed_risks(_drafts(spark, d)), "risks"))


def dedup_greedy(spark: SparkSession, d: str) -> DataFrame:
    return dedup.merged_findings(_drafts(spark, d)).select("document", "seq", "severity", "comment", "proposal", "page", "clause", "quote", "verified", "confidence", F.array_join("merged", ",").alias("merged"))


def passage_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    asked = docs.select(F.col("doc_id").alias("document"), F.lit(0).cast("long").alias("question"), F.substring_index("text", "\n", 1).alias("text"), F.lit(None).cast("long").alias("selected_page"))
    return context.passage_scores(pages(spark, d), asked).select("document", "page", "part", "score", F.length("content").cast("long").alias("n_chars"))


def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    asked = docs.select(F.col("doc_id").alias("document"), F.lit(0).cast("long").alias("question"), F.substring_index("text", "\n", 1).alias("text"), F.lit(None).cast("long").alias("selected_page"))
    chosen = context.budgeted_passages(context.passage_scores(pages(spark, d), asked), budget=8000)
    return chosen.select("document", "page", "part", "score", F.length("content").cast("long").alias("n_chars"))


def budget_skipfit(spark: SparkSession, d: str) -> DataFrame:
    messages = table(spark, d, "conversations").withColumn("age", -F.col("turn")).withColumn("size", F.length("text"))
    return context.fitting(messages, "conv_id", ["age", "role", "text"], "size", 300, 12).select("conv_id", "turn", "role", "size")


def csv_guard(spark: SparkSession, d: str) -> DataFrame:
    sign = F.when(F.col("doc_id") % 5 == 0, "=").when(F.col("doc_id") % 5 == 1, " -").when(F.col("doc_id") % 5 == 2, "\t").otherwise("")
    return table(spark, d, "documents").select("doc_id", F.sha2(reports.guarded_cell(F.concat(sign, F.col("text"))), 256).alias("cell"))


def token_normal(spark: SparkSession, d: str) -> DataFrame:
    tokens = quotes.normal_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(tokens).cast("long").alias("n"), F.sha2(F.array_join(tokens, " "), 256).alias("digest"))


def clause_of_quotes(spark: SparkSession, d: str) -> DataFrame:
    lines = structure.lines_of(numbered_pages(spark, d))
    # positions number the tokens of a document through all its lines; a token without a normal form has none
    written = F.transform(F.filter(F.split("text", r"\s+"), lambda t: t != ""), lambda t, i: F.struct(t.alias("token"), (i == 0).alias("starts_line")))
    solid = lines.withColumn("tokens", F.filter(written, lambda t: quotes.has_norm(t["token"])))
    before = Window.partitionBy("document").orderBy("page", "line").rowsBetween(Window.unboundedPreceding, -1)
    placed = solid.withColumn("base", F.coalesce(F.sum(F.size("tokens")).over(before), F.lit(0)).cast("long"))
    tokens = placed.select("document", "base", F.posexplode("tokens").alias("at", "t")).select("document", (F.col("base") + F.col("at")).alias("position"), "t.token", "t.starts_line")
    asked = placed.where("line % 3 = 2").select("document", F.col("line").alias("quote"), F.col("base").alias("first"), F.col("base").alias("last"))
    return quotes.clause_of_quotes(tokens, asked)


def events_stream_diff(spark: SparkSession, d: str) -> DataFrame:
    """Changes of each user's event type, by a streaming query that drains the table and stops."""
    source = f"{d}/events.parquet"
    events = spark.read.parquet(source)
    out = f"{shared_dir(spark)}/lexweave-stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(events.schema).parquet(f"{source}*").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    changed = feeds.changes_stream(stream, "user_id", "ts", "event_type", forget=False)
    query = changed.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def review_chain(spark: SparkSession, d: str) -> DataFrame:
    """The whole review: lines, segments, chunks, lexical and vector ranks and their fusion, keyword findings, quotes
    verified in their chunk and its pages, merged findings, then counts, score and light of each document with a finding,
    and how many of its findings have a verified quote. Each rule looks at its best chunks of the corpus. A document
    without text, and one that no rule finds anything in, has no row."""
    laid = numbered_pages(spark, d)
    parts = structure.segments(structure.lines_of(laid))
    chunks = staged(structure.chunks(parts).withColumn("key", F.concat_ws("/", "document", "chunk")), "chunks")
    told = chunks.select("key", drafts.embedding_text(F.col("title"), F.col("content")).alias("text"))
    asked, depth = table(spark, d, "benchmark"), retrieval.candidates_for(retrieval.TOP_K)
    lexical = retrieval.lexical_ranks(asked, told, "item_id", "key", depth)
    vectors = retrieval.vector_ranks(retrieval.hash_embeddings(asked, "item_id", "text"), retrieval.hash_embeddings(told, "key", "text"), "item_id", "key", depth)
    ranks = retrieval.fused(vectors, lexical, "item_id", "key", depth)
    contexts = ranks.join(chunks, "key").select("document", F.col("item_id").alias("rule"), "chunk", "content", "score", "fts_hit")
    rules = _rules(spark, d)
    found = evaluate.guarded(evaluate.keyword_findings(staged(contexts, "contexts"), rules))
    placed = found.join(chunks.select("document", "chunk", "page", "page_end", F.col("title").alias("place"), F.col("content").alias("fragment")), ["document", "chunk"]).join(rules.select("rule", "title"), "rule")
    judged = quotes.verify_quotes(quotes.with_page_texts(placed.withColumn("quote_id", F.col("rule")), laid))
    clause = worklists.clause_label(F.lit(None).cast("string"), F.col("place"))
    each = judged.select("document", F.col("rule").alias("seq"), "severity", "title", F.lit(None).cast("string").alias("reference"), "comment", "proposal", "page", clause.alias("clause"), "quote", F.array().cast("array<string>").alias("boxes"), "verified", "confidence")
    merged = staged(dedup.merged_findings(each).withColumn("rule", F.col("seq")).withColumn("review_status", F.lit("NEW")), "merged")
    counts = findings.severity_counts(merged, "document")
    stand = merged.groupBy("document").agg(F.count_if("verified").alias("verified"))
    return counts.join(stand, "document").select("document", "critical", "warning", "low", "rules_checked", "verified", findings.score().alias("score"), findings.light().alias("light"))


QUERIES = {f.__name__: f for f in (
    lexical_rank, carry_section, line_segments, outline_sections, page_paragraphs, chunk_pack, law_count, vector_rank,
    rrf_fusion, mmr_select, hash_embedding, rule_cache_key, stem_sets, noise_filter, heading_filter, keyword_evaluate,
    phrase_search_count, quote_verification, duplicate_pairs, dedup_greedy, passage_scores, budget_prefix, budget_skipfit,
    csv_guard, token_normal, clause_of_quotes, events_stream_diff, review_chain,
)}

_STEMS = "list_transform(regexp_extract_all(replace(lower(text), 'ё', 'е'), '[\\p{L}\\p{N}_]{4,}'), lambda w: left(w, 6))"
LEXICAL = f"""
q AS (SELECT DISTINCT item_id, unnest({_STEMS}) AS stem FROM benchmark),
t AS (SELECT doc_id, stem, count(*) AS tf FROM (SELECT doc_id, unnest({_STEMS}) AS stem FROM documents) GROUP BY 1, 2),
lex AS (SELECT * FROM (SELECT item_id, doc_id, CAST(sum(tf) AS BIGINT) AS rank_value, row_number() OVER (PARTITION BY item_id ORDER BY sum(tf) DESC, doc_id) AS lexical_rank
  FROM q JOIN t USING (stem) GROUP BY item_id, doc_id) WHERE lexical_rank <= 12)"""
VECTOR = """
e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY distance, doc_id) AS vector_rank FROM (
  SELECT a.vec_id // 20 AS item_id, b.vec_id AS doc_id, 1 - list_cosine_similarity(a.v, b.v) AS distance FROM e a JOIN e b ON a.vec_id % 20 = 0) WHERE distance <= 0.8) WHERE vector_rank <= 12)"""
WORDS = r"list_distinct(regexp_extract_all(replace(lower(quote), 'ё', 'е'), '\p{L}{3,}'))"
_PASSAGES = r"""
z AS (SELECT doc_id AS document, text, unnest(range(CAST(ceil(length(text) / 3500.0) AS BIGINT))) AS part, string_split(text, chr(10))[1] AS ask FROM documents WHERE text <> ''),
y AS (SELECT document, part, substr(text, part * 3500 + 1, 3500) AS content, ask FROM z),
ps AS (SELECT document, CAST(1 AS BIGINT) AS page, part, CAST(len(list_intersect(list_distinct(list_transform(regexp_extract_all(lower(content), '[а-яёa-z0-9]+'), lambda w: left(w, 5))),
  list_distinct(list_transform(list_filter(regexp_extract_all(lower(ask), '[а-яёa-z0-9]+'), lambda w: length(w) > 2), lambda w: left(w, 5))))) AS BIGINT)
  + CASE WHEN list_contains(list_transform(regexp_extract_all(lower(ask), '(?:стр(?:аниц[аеуы]?)?\.?|page)\s*(\d+)', 1), lambda n: TRY_CAST(n AS BIGINT)), 1) THEN 500 ELSE 0 END AS score,
  length(content) AS n_chars FROM y)"""
def _norm(word: str) -> str:
    return f"replace(replace(trim(replace(lower({word}), 'ё', 'е'), '{_TRIM}'), '–', '-'), '—', '-')"


_TRIM = "«»\"''“”„()[]{}.,;:!?…"
_TOKENS = f"list_filter(list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda t: t <> ''), lambda t: {_norm('t')}), lambda t: t <> '')"
BY_LINE = "x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents)"
ORACLE_SQL = {
    "lexical_rank": f"WITH {LEXICAL} SELECT item_id, doc_id, rank_value, lexical_rank FROM lex",
    "vector_rank": f"WITH {VECTOR} SELECT item_id, doc_id, round(distance, 6) AS distance, vector_rank FROM vec",
    "rrf_fusion": f"""WITH {LEXICAL}, {VECTOR}, m AS (SELECT item_id, doc_id, coalesce(1.0 / (60 + vector_rank), 0) + coalesce(1.0 / (60 + lexical_rank), 0) AS score, lexical_rank IS NOT NULL AS fts_hit
      FROM vec FULL JOIN lex USING (item_id, doc_id)), n AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM m)
      SELECT item_id, doc_id, round(CAST(score AS DOUBLE), 9) AS score, fts_hit, place FROM n WHERE place <= 12""",
    "carry_section": f"WITH {LINES} SELECT document, line, clause, section, CAST(segment AS BIGINT) AS segment FROM carried",
    "line_segments": f"""WITH {LINES} SELECT document, CAST(segment AS BIGINT) AS segment, arg_min(clause, line) FILTER (WHERE true) AS clause, max(section) AS section,
      regexp_replace(string_agg(trim(text), chr(10) ORDER BY line), '([\\p{{L}}\\p{{N}}_])-\\n([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g') AS text FROM carried GROUP BY document, segment""",
    "outline_sections": f"""WITH {LINES} SELECT document, section, CAST(1 AS BIGINT) AS page, count(c) AS n, coalesce(string_agg(c, ',' ORDER BY segment), '') AS clauses FROM
      (SELECT document, section, segment, CASE WHEN regexp_matches(clause, '^\\d+\\.\\d+$') THEN clause END AS c FROM carried QUALIFY row_number() OVER (PARTITION BY document, segment ORDER BY line) = 1) GROUP BY document, section""",
    "law_count": r"""WITH c AS (SELECT doc_id, text || CASE lang WHEN 'en' THEN ' 44-ФЗ' WHEN 'de' THEN ' 223 - фз, № 44' ELSE '' END AS t FROM documents),
      n AS (SELECT doc_id, len(regexp_extract_all(t, '(?i)44\s*-\s*ФЗ|№\s*44\s*-?\s*ФЗ|от\s+05\.04\.2013')) AS a, len(regexp_extract_all(t, '(?i)223\s*-\s*ФЗ|№\s*223\s*-?\s*ФЗ|от\s+18\.07\.2011')) AS b FROM c)
      SELECT doc_id, CASE WHEN a = 0 AND b = 0 THEN NULL WHEN a >= b THEN '44-FZ' ELSE '223-FZ' END AS law FROM n""",
    "rule_cache_key": "SELECT item_id, 'local-hash#' || left(sha256(text), 12) AS key FROM benchmark",
    "stem_sets": f"SELECT stem, count(*) AS n FROM (SELECT unnest(list_distinct({_STEMS})) AS stem FROM documents) GROUP BY stem",
    "noise_filter": rf"""WITH {BY_LINE}, s AS (SELECT *, length(regexp_replace(text, '[\s\p{{Z}}\x85\x0b]', '', 'g')) AS solid FROM x)
      SELECT doc_id, line, solid = 0 OR len(regexp_extract_all(text, '\p{{L}}')) < 0.55 * solid AS noise FROM s""",
    "heading_filter": rf"""WITH {BY_LINE}, s AS (SELECT doc_id, line, trim(text) AS t FROM x)
      SELECT doc_id, line, length(t) < 15 OR regexp_matches(t, '(?i)^(раздел|статья|приложение|глава|пункт|п\.|ст\.)\s*\d+[\.\d\s\p{{L}}\p{{N}}_\(\)]*$')
      OR (length(t) < 90 AND len(regexp_extract_all(t, '\p{{L}}')) > 0 AND len(regexp_extract_all(t, '\p{{L}}')) = len(regexp_extract_all(t, '\p{{Lu}}')))
      OR regexp_matches(t, '^[\p{{L}}\p{{N}}_\s]{{1,30}}:\s*(\d+(\.\d+)*\.?)?$') OR regexp_matches(t, '^[\d\.\s\(\)\-]+$') AS heading FROM s""",
    "phrase_search_count": f"""WITH h AS (SELECT doc_id, array_to_string({_TOKENS}, ' ') AS hay FROM documents), n AS (SELECT item_id, array_to_string({_TOKENS}, ' ') AS needle FROM benchmark)
      SELECT doc_id, item_id, CAST((length(hay) - length(replace(hay, needle, ''))) // length(needle) AS BIGINT) AS total, CAST(instr(hay, needle) - 1 AS BIGINT) AS first FROM h JOIN n ON needle <> '' AND contains(hay, needle)""",
    "duplicate_pairs": rf"""WITH {BY_LINE}, f AS (SELECT doc_id AS document, line AS seq, text AS quote, CASE WHEN line % 5 > 0 THEN line % 4 END AS page,
        CASE WHEN line % 3 = 0 THEN CAST(line % 5 AS VARCHAR) || CASE WHEN line % 2 = 0 THEN '.1' ELSE '' END END AS clause FROM x WHERE line % 4 <> 3),
      w AS (SELECT *, {WORDS} AS words FROM f),
      p AS (SELECT a.document, a.seq AS a, b.seq AS b, a.clause AS ca, b.clause AS cb, a.page AS pa, b.page AS pb, CASE WHEN least(len(a.words), len(b.words)) > 0 THEN len(list_intersect(a.words, b.words)) / least(len(a.words), len(b.words)) ELSE 0 END AS overlap
        FROM w a JOIN w b ON a.document = b.document AND a.seq < b.seq)
      SELECT document, a, b, round(overlap, 4) AS overlap FROM p WHERE overlap >= 0.7 OR coalesce(ca = cb AND CASE WHEN contains(ca, '.') THEN pa IS NULL OR pb IS NULL OR pa = pb ELSE overlap >= 0.35 END, false)""",
    "quote_verification": r"""WITH p AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
      s AS (SELECT *, lines[2] AS second, array_to_string(string_split(lines[2], ' ')[len(string_split(lines[2], ' ')) // 2 + 1 :], ' ') AS half FROM p WHERE lines[2] <> ''),
      f AS (SELECT doc_id, 'as it is' AS form, second AS quote, text AS fragment, text AS page FROM s UNION ALL SELECT doc_id, 'digit', '8 ' || second, '7 ' || second, text FROM s
        UNION ALL SELECT doc_id, 'negation', half || ' end', text || ' не ' || half || ' end', text || ' не ' || half || ' end' FROM s UNION ALL SELECT doc_id, 'page', second, text, lines[1] FROM s),
      x AS (SELECT doc_id, form, regexp_matches(quote, '[\p{L}\p{N}]') AS says, list_transform([quote, fragment, page], lambda t: chr(10) || array_to_string(regexp_extract_all(replace(t, chr(173), ''),
        '[+\-−]?\p{Nd}+(?:[.,:/]\p{Nd}+)*[%‰]?|[\p{L}\p{Nl}\p{No}]+|[^\p{L}\p{N}_\s]|_'), chr(10)) || chr(10)) AS l FROM f),
      y AS (SELECT doc_id, form, says, l[1] AS q, list_transform(l[2:3], lambda t: string_split(t, l[1])) AS cuts FROM x)
      SELECT doc_id, form, says AND list_min(list_transform(cuts, lambda c: CAST(len(list_filter(c[1:len(c) - 1], lambda b: NOT regexp_matches(b, '(?i)\n(не|ни|без)$')
        AND NOT (regexp_matches(q, '^\n\p{Nd}') AND regexp_matches(b, '\n[-+−±<>≤≥=]$')))) > 0 AS INT))) = 1 AS verified FROM y""",
    "clause_of_quotes": f"""WITH {LINES}, k AS (SELECT document, line, list_filter(list_transform(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda t: t <> ''), lambda t, i: {{'t': t, 'n': {_norm("t")}, 'i': i}}), lambda t: t.n <> '') AS words FROM lines),
      p AS (SELECT *, coalesce(sum(len(words)) OVER (PARTITION BY document ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM k),
      m AS (SELECT document, base AS at, CASE WHEN regexp_matches(words[1].n, '^\\d{{1,2}}$') AND words[1].t LIKE '%.' THEN '' ELSE words[1].n END AS mark FROM p WHERE words[1].i = 1
        AND (regexp_matches(words[1].n, '^\\d{{1,2}}(\\.\\d{{1,3}}){{1,3}}$') OR regexp_matches(words[1].n, '^\\d{{1,2}}$') AND words[1].t LIKE '%.'))
      SELECT q.document, line AS quote, CASE WHEN base - m.at < 600 THEN nullif(mark, '') END AS clause FROM (SELECT * FROM p WHERE line % 3 = 2) q ASOF LEFT JOIN m ON m.document = q.document AND m.at <= q.base""",
    "passage_scores": f"WITH {_PASSAGES} SELECT document, page, part, score, n_chars FROM ps",
    "budget_prefix": f"""WITH {_PASSAGES}, b AS (SELECT *, coalesce(sum(n_chars) OVER (PARTITION BY document ORDER BY score DESC, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
      row_number() OVER (PARTITION BY document ORDER BY score DESC, part) AS n FROM ps) SELECT document, page, part, score, CAST(least(n_chars, 8000 - before) AS BIGINT) AS n_chars FROM b WHERE n <= 80 AND before < 8000""",
    "budget_skipfit": """WITH RECURSIVE m AS (SELECT *, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS i FROM conversations),
      r AS (SELECT conv_id, turn, role, size, i, size <= 300 AS took, CASE WHEN size <= 300 THEN 300 - size ELSE 300 END AS room, CAST(size <= 300 AS INT) AS n FROM m WHERE i = 1
        UNION ALL SELECT m.conv_id, m.turn, m.role, m.size, m.i, m.size <= room AND n < 12, CASE WHEN m.size <= room AND n < 12 THEN room - m.size ELSE room END, n + CAST(m.size <= room AND n < 12 AS INT)
        FROM r JOIN m ON m.conv_id = r.conv_id AND m.i = r.i + 1)
      SELECT conv_id, turn, role, size FROM r WHERE took""",
    "csv_guard": r"""WITH c AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '=' WHEN 1 THEN ' -' WHEN 2 THEN chr(9) ELSE '' END || text AS t FROM documents)
      SELECT doc_id, sha256(CASE WHEN regexp_matches(t, '^(?:[\s\x00-\x1f]*[=+\-@]|[\t\r\n])') THEN '''' || t ELSE t END) AS cell FROM c""",
    "token_normal": f"SELECT doc_id, CAST(len({_TOKENS}) AS BIGINT) AS n, sha256(array_to_string({_TOKENS}, ' ')) AS digest FROM documents",
    "events_stream_diff": """SELECT user_id, ts, before, event_type FROM (SELECT user_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS before FROM events)
      WHERE before IS DISTINCT FROM event_type""",
}
