"""Pages scanned word by word, quotes located in them, and findings from answers, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators import drafts, located, reports, search
from lexweave.plans.rollups import table

#: Lines that stand on one page.
PAGE = 10
#: Bytes of text in a partition whose words are laid out and sorted, which take over a hundred times as much memory there.
PIECE = 2 << 20


def _words(spark: SparkSession, d: str, digits: int | None = 1, n: int | None = None) -> DataFrame:
    return scanned(table(spark, d, "documents").select(F.col("doc_id").alias("document"), "text"), digits, n or parts(spark, d))


def parts(spark: SparkSession, d: str) -> int:
    """How many partitions the documents fill, at ``PIECE`` bytes of text each; no fewer than there are cores."""
    size = table(spark, d, "documents").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(spark.sparkContext.defaultParallelism, -(-size // PIECE))


def scanned(pages: DataFrame, digits: int | None = 1, parts: int | None = None) -> DataFrame:
    """Texts (document, text) as scans: ten lines a page, and a hyphen after the last word of every third line. With
    ``parts`` the texts are shuffled into so many partitions by document, and none of their words."""
    texts = pages.repartition(parts, "document") if parts else pages
    lines = texts.select("document", F.posexplode(F.split("text", "\n")).alias("line", "x"))
    split = lines.withColumn("words", F.split("x", " "))
    words = split.select("document", "line", F.size("words").alias("n"), F.posexplode("words").alias("i", "word"))
    cut = (F.col("line") % 3 == 0) & (F.col("i") == F.col("n") - 1) & (F.col("word") != "")
    at, row = F.col("i") * 10, F.col("line") * 10
    return located.laid_out_words(
        words.select(
            "document",
            (F.floor(F.col("line") / PAGE) + 1).alias("page"),
            (F.col("line").cast("long") * (1 << 31) + F.col("i")).alias("seq"),
            F.when(cut, F.concat("word", F.lit("-"))).otherwise(F.col("word")).alias("word"),
            F.floor(F.col("line") / 4).alias("block"),
            (F.col("line") % 4).alias("line"),
            (at + 0.04).alias("x0"),
            (row + 0.04).alias("y0"),
            (at + 8.96).alias("x1"),
            (row + 8.96).alias("y1"),
        ),
        digits,
        dealt=parts is not None,
    )


def page_scan_texts(spark: SparkSession, d: str) -> DataFrame:
    return located.page_texts(_words(spark, d)).select("document", "page", F.sha2("text", 256).alias("digest"))


def word_tokens(spark: SparkSession, d: str) -> DataFrame:
    tokens = located.positioned_tokens(_words(spark, d))
    return tokens.select("document", F.col("position").cast("long").alias("position"), "page", "norm", "starts_line", F.size("words").cast("long").alias("n_words"))


def quote_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Of every fifth line the second to the fifth word as a quote."""
    n = parts(spark, d)
    tokens = located.positioned_tokens(_words(spark, d, None, n))
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("document"), F.posexplode(F.split("text", "\n")).alias("quote_id", "x")).where("quote_id % 5 = 1")
    quotes = lines.select("document", "quote_id", F.array_join(F.slice(F.split("x", " "), 2, 4), " ").alias("quote"))
    # the quotes go where the tokens are, which would be shuffled to them otherwise
    boxes = located.boxes_of_quotes(tokens, quotes.repartition(n, "document"))
    return boxes.select("document", F.col("quote_id").cast("long").alias("quote_id"), "page", F.col("line").cast("long").alias("line"), *located.BOX)


def draft_findings(spark: SparkSession, d: str) -> DataFrame:
    """Lines are fragments. Answers quote the first three lines; some change a quote or name no fragment."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document"), F.lit(0).alias("rule"), F.split("text", "\n").alias("lines"))
    k = F.col("document")
    page_of = lambda at: F.array_join(F.slice("lines", (F.floor(at / PAGE) * PAGE + 1).cast("int"), F.lit(PAGE)), "\n")
    placed = docs.select("document", "rule", F.posexplode("lines").alias("at", "content"), "lines").where(F.col("at") < PAGE)
    chunks = placed.select("document", "rule", (F.col("at") + 1).alias("ordinal"), "content", page_of(F.col("at")).alias("page_text"))

    def claim(n: int, severity: str) -> Column:
        own = F.get("lines", F.lit(n))
        quote = F.when(k % 3 == 0, F.concat(F.lit("altered "), own)).otherwise(own) if n == 1 else own
        named = F.when(k % 2 == 0, "F0").otherwise("F3") if n == 2 else F.lit(f"F{n + 1}")
        return F.struct(named.alias("fragment"), quote.alias("quote"), F.lit(severity).alias("severity"), F.lit("comment").alias("comment"), F.lit(0.5).alias("confidence"))

    verdict = F.when(k % 7 == 0, "NOT_FOUND").when(k % 7 == 1, "UNKNOWN").when(k % 7 == 2, None).when(k % 7 < 5, "OK").otherwise("RISK")
    graded = F.when(k % 3 == 0, "RED").when(k % 3 == 1, "YELLOW").otherwise("LOW")
    claims = F.array(*[claim(n, s) for n, s in enumerate(("RED", "YELLOW", "LOW"))])
    answers = docs.select("document", "rule", graded.alias("rule_severity"), verdict.alias("verdict"), F.lit("explained").alias("explanation"), claims.alias("claims"))
    return drafts.drafts(answers, chunks).select("document", F.col("place").cast("long").alias("place"), "severity", "reason", "quote", "comment")


def retold_rules(spark: SparkSession, d: str) -> DataFrame:
    k, title, told = F.col("p_partkey"), F.col("p_name"), F.concat(F.col("p_type"), F.lit("."))
    query = F.when(k % 3 > 0, drafts.default_query(title, told)).otherwise("own")
    prompt = F.when(k % 5 > 0, drafts.default_prompt(title, told))
    rules = table(spark, d, "part").select("p_partkey", title.alias("title"), told.alias("description"), F.when(k % 2 == 0, F.upper(title)).otherwise(title).alias("new_title"), F.when(k % 4 == 0, F.lit("")).otherwise(told).alias("new_description"), query.alias("query"), prompt.alias("prompt"), F.array(k).alias("vector"))
    return drafts.retold_rules(rules).select("p_partkey", "query", "prompt", F.col("vector").isNotNull().alias("has_vector"))


def history_details(spark: SparkSession, d: str) -> DataFrame:
    """Events as an audit log: their ids choose action and details."""
    k = F.col("event_id")
    names = F.array(*[F.lit(a) for a in (*search.ACTIONS, "OTHER")])
    action = F.get(names, (k % (len(search.ACTIONS) + 1)).cast("int"))
    mode = F.get(F.array(*[F.lit(m) for m in (*search.REPORTS, "other")]), (k % 5).cast("int"))
    text = lambda head: F.concat(F.lit(head), k)
    fields = {"file": F.when(k % 3 > 0, text("f")), "project": F.when(k % 2 == 0, text("p")), "title": text("t"), "documents": k % 30, "rules": k % 25, "critical": k % 22, "warning": k % 4, "low": k % 2, "error": text("e"), "from": text("a"), "to": text("b"), "status": F.lit("NEW"), "enabled": k % 5 == 0, "mode": mode, "format": F.lit("csv")}
    log = table(spark, d, "events").select("event_id", action.alias("action"), F.to_json(F.struct(*[v.alias(n) for n, v in fields.items()])).alias("details"))
    return search.described(log, "action", "details").select("event_id", "title", "detail")


def source_labels(spark: SparkSession, d: str) -> DataFrame:
    """Orders as documents of their customers' uploads; every third upload is an archive."""
    k = F.col("o_custkey")
    upload = F.concat(F.lit("up"), k, F.when(k % 3 == 0, ".ZIP").otherwise(".pdf"))
    name = F.when(F.col("o_orderkey") % 2 == 0, upload).otherwise(F.concat(F.lit("doc"), F.col("o_orderkey")))
    path = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("in/"), upload))
    docs = table(spark, d, "orders").select("o_orderkey", "o_custkey", upload.alias("upload"), name.alias("name"), path.alias("path"))
    counts = docs.groupBy("o_custkey", "upload").agg(F.count("*").alias("n"), F.count_if(reports.from_archive(F.col("upload"), F.col("name"), F.col("path"))).alias("named"))
    return counts.select("o_custkey", reports.source_label(F.col("upload"), F.col("n")).alias("label"), "named")


QUERIES = {f.__name__: f for f in (page_scan_texts, word_tokens, quote_boxes, draft_findings, retold_rules, history_details, source_labels)}

_STRIP = "«»\"''“”„()[]{}.,;:!?…"


def norm(word: str) -> str:
    return f"replace(replace(trim(replace(lower({word}), 'ё', 'е'), '{_STRIP}'), '–', '-'), '—', '-')"


_SPLIT = "l AS (SELECT doc_id AS document, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents WHERE text IS NOT NULL),"
WORDS = """
w AS (SELECT document, line, unnest(string_split(x, ' ')) AS word, unnest(range(len(string_split(x, ' ')))) AS i, len(string_split(x, ' ')) AS n FROM l),
c AS (SELECT document, line // 10 + 1 AS page, line, i, trim(translate(word || CASE WHEN line % 3 = 0 AND i = n - 1 AND word <> '' THEN '-' ELSE '' END, chr(173) || chr(160) || chr(8239) || chr(9), '-   '), ' ' || chr(10) || chr(13)) AS word FROM w),
s AS (SELECT *, lead(word) OVER p AS rest, lead(line) OVER p AS rest_line, lead(i) OVER p AS rest_i, lag(line) OVER p AS last_line FROM c WHERE word <> '' WINDOW p AS (PARTITION BY document, page ORDER BY line, i)),
h AS (SELECT *, coalesce(word LIKE '%-' AND length(word) > 2 AND rest_line <> line AND regexp_matches(rest, '^\\p{Ll}'), false) AS head FROM s),
k AS (SELECT *, coalesce(lag(head) OVER (PARTITION BY document, page ORDER BY line, i), false) AS taken FROM h)"""
_SCAN = _SPLIT + WORDS
TOKENS = f"""{WORDS},
n AS (SELECT *, {norm("CASE WHEN head THEN left(word, length(word) - 1) || rest ELSE word END")} AS norm FROM k WHERE NOT taken),
t AS (SELECT *, row_number() OVER (PARTITION BY document ORDER BY page, line, i) - 1 AS position FROM n WHERE norm <> '')"""
_TOKENS = _SPLIT + TOKENS


def _plural(n: str, forms: tuple[str, str, str]) -> str:
    return f"{n} || ' ' || CASE WHEN {n} % 10 = 1 AND {n} % 100 <> 11 THEN '{forms[0]}' WHEN {n} % 10 BETWEEN 2 AND 4 AND {n} % 100 NOT BETWEEN 12 AND 14 THEN '{forms[1]}' ELSE '{forms[2]}' END"


_TITLES = f"[{', '.join(repr(t) for t in search.ACTIONS.values())}, 'OTHER']"
_NAMES = f"[{', '.join(repr(t) for t in search.ACTIONS)}, 'OTHER']"
_MODES = f"[{', '.join(repr(t) for t in search.REPORTS.values())}, 'other']"
ORACLE_SQL = {
    "history_details": f"""WITH e AS (SELECT event_id AS k, {_NAMES}[event_id % {len(search.ACTIONS) + 1} + 1] AS a, {_TITLES}[event_id % {len(search.ACTIONS) + 1} + 1] AS t,
        CASE WHEN event_id % 3 > 0 THEN 'f' || event_id END AS f, CASE WHEN event_id % 2 = 0 THEN 'p' || event_id END AS p FROM events)
      SELECT k AS event_id, CASE WHEN a = 'ANALYSIS_CREATED' AND p IS NOT NULL THEN '{search.IN_PROJECT}' WHEN a = 'RULE_TOGGLED' AND k % 5 = 0 THEN '{search.TURNED_ON}' ELSE t END AS title,
      CASE WHEN a LIKE 'PROJECT%' OR a LIKE 'RULE%' THEN 't' || k WHEN a IN ('ANALYSIS_RERUN', 'DOCUMENT_REANALYZE', 'ANALYSIS_DELETED') THEN coalesce(f, '')
        WHEN a = 'ANALYSIS_CREATED' THEN concat_ws(' · ', p, f, CASE WHEN k % 30 > 1 THEN {_plural("(k % 30)", search.DOCUMENTS)} || ' в архиве' END) WHEN a = 'ANALYSIS_STARTED' THEN concat_ws(' · ', p, f)
        WHEN a = 'ANALYSIS_COMPLETED' THEN concat_ws(' · ', f, {_plural("(k % 25)", search.RULES)}, {_plural("(k % 22)", search.CRITICAL)}, (k % 4) || ' требуют внимания', CASE WHEN k % 2 = 1 THEN '1 с низким риском' END)
        WHEN a = 'ANALYSIS_FAILED' THEN concat_ws(' · ', f, 'e' || k) WHEN a = 'DOCUMENT_RENAMED' THEN 'a' || k || ' → b' || k WHEN a = 'FINDING_REVIEWED' THEN 't' || k || ' · NEW'
        WHEN a = 'REPORT_DOWNLOADED' THEN {_MODES}[k % 5 + 1] || ' · CSV' ELSE '' END AS detail FROM e""",
    "source_labels": f"""WITH d AS (SELECT o_custkey, o_custkey % 3 = 0 AS packed, o_orderkey % 2 = 1 OR o_orderkey % 4 = 0 AS own FROM orders)
      SELECT o_custkey, CASE WHEN packed OR count(*) > 1 THEN '{reports.SOURCE_ARCHIVE}' ELSE '{reports.SOURCE_FILE}' END AS label, count(*) FILTER (WHERE packed OR own) AS named FROM d GROUP BY o_custkey, packed""",
    "page_scan_texts": f"""WITH {_SCAN}, j AS (SELECT document, page, line, string_agg(word, ' ' ORDER BY i) AS text FROM s GROUP BY ALL)
      SELECT document, page, sha256(string_agg(text, chr(10) ORDER BY line)) AS digest FROM j GROUP BY ALL""",
    "word_tokens": f"WITH {_TOKENS} SELECT document, position, page, norm, last_line IS NULL OR last_line <> line AS starts_line, 1 + CAST(head AS BIGINT) AS n_words FROM t",
    "quote_boxes": f"""WITH {_TOKENS}, y AS (SELECT document, chr(10) || string_agg(norm, chr(10) ORDER BY position) || chr(10) AS hay FROM t GROUP BY document),
      a AS (SELECT document, line AS quote_id, list_filter(list_transform(list_filter(string_split(x, ' ')[2:5], lambda v: v <> ''), lambda v: {norm("v")}), lambda v: v <> '') AS q FROM l WHERE line % 5 = 1),
      f AS (SELECT document, quote_id, len(q) AS n, hay, instr(hay, chr(10) || array_to_string(q, chr(10)) || chr(10)) AS spot FROM a JOIN y USING (document) WHERE len(q) > 0),
      r AS (SELECT document, quote_id, len(string_split(left(hay, spot), chr(10))) - 2 AS first, n FROM f WHERE spot > 0),
      b AS (SELECT r.document, quote_id, page, unnest(CASE WHEN head THEN [line, rest_line] ELSE [line] END) AS line, unnest(CASE WHEN head THEN [i, rest_i] ELSE [i] END) AS i FROM r JOIN t ON t.document = r.document AND position BETWEEN first AND first + n - 1),
      m AS (SELECT document, page, line, dense_rank() OVER (PARTITION BY document, page ORDER BY line) - 1 AS nth FROM s GROUP BY document, page, line)
      SELECT document, quote_id, page, nth AS line, CAST(min(10 * i) AS DOUBLE) AS x0, CAST(10 * line AS DOUBLE) AS y0, CAST(max(10 * i + 9) AS DOUBLE) AS x1, CAST(10 * line + 9 AS DOUBLE) AS y1
      FROM b JOIN m USING (document, page, line) GROUP BY document, quote_id, page, line, nth""",
    "draft_findings": r"""WITH d AS (SELECT doc_id AS document, string_split(text, chr(10)) AS lines, CASE WHEN doc_id % 7 = 0 THEN 'NOT_FOUND' WHEN doc_id % 7 = 1 THEN 'UNKNOWN' WHEN doc_id % 7 = 2 THEN NULL WHEN doc_id % 7 < 5 THEN 'OK' ELSE 'RISK' END AS verdict FROM documents),
      e AS (SELECT *, CASE WHEN verdict IS NULL THEN 'broken' WHEN lines IS NULL THEN 'no_chunks' WHEN verdict = 'UNKNOWN' THEN 'undecided' END AS alone FROM d WHERE verdict IS NULL OR verdict <> 'NOT_FOUND'),
      c AS (SELECT *, lines[k + 1] AS line, NOT (k = 2 AND document % 2 = 0) AND len(lines) > k AS known FROM (SELECT *, unnest(range(3)) AS k FROM e WHERE alone IS NULL)),
      v AS (SELECT *, coalesce(known AND NOT (document % 3 = 0 AND k = 1) AND length(trim(line)) >= 20 AND len(regexp_extract_all(line, '\p{L}+')) >= 3, false) AS stands FROM c),
      r AS (SELECT *, CASE WHEN NOT known THEN 'no_fragment' WHEN NOT stands THEN 'unverified' END AS reason FROM v)
      SELECT document, 0 AS place, 'UNKNOWN' AS severity, alone AS reason, NULL AS quote, CASE WHEN alone = 'undecided' THEN 'explained' END AS comment FROM e WHERE alone IS NOT NULL
      UNION ALL SELECT document, 0, CASE WHEN stands THEN 'GREEN' ELSE 'UNKNOWN' END, reason, CASE WHEN stands THEN line END, CASE WHEN stands THEN 'explained' END
        FROM (SELECT *, coalesce(min(k) FILTER (WHERE reason IS NOT NULL) OVER (PARTITION BY document), 0) AS chosen FROM r WHERE verdict = 'OK') WHERE k = chosen
      UNION ALL SELECT document, k, CASE WHEN stands THEN ['RED', 'YELLOW', 'LOW'][greatest(k, document % 3) + 1] ELSE 'UNKNOWN' END, reason, CASE WHEN stands THEN line END, CASE WHEN stands THEN 'comment' END
        FROM (SELECT *, row_number() OVER (PARTITION BY document, stands, CASE WHEN stands THEN line ELSE CAST(k AS VARCHAR) END ORDER BY k) AS nth FROM r WHERE verdict = 'RISK') WHERE nth = 1""",
    "retold_rules": f"""WITH p AS (SELECT p_partkey AS k, p_name AS t, p_type || '.' AS d, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS nt, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_type || '.' END AS nd FROM part)
      SELECT k AS p_partkey, CASE WHEN k % 3 > 0 THEN trim(nt || '. ' || nd, ' .') ELSE 'own' END AS query,
      CASE WHEN k % 5 > 0 THEN '{drafts.PROMPT_START}' || nt || '».' || CASE WHEN nd <> '' THEN ' ' || rtrim(nd, '.') || '.' ELSE '' END || '{drafts.PROMPT_END}' END AS prompt,
      k % 3 = 0 OR trim(nt || '. ' || nd, ' .') = trim(t || '. ' || d, ' .') AS has_vector FROM p""",
}
