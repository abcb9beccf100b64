"""Lists of rules, issues and notes over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators import findings, search, worklists
from lexweave.plans import rollups
from lexweave.plans.rollups import _PLACE, DOCS, FINDINGS, table


def rule_filter(spark: SparkSession, d: str) -> DataFrame:
    return worklists.rule_list(rollups.rules(spark, d), True, "44-FZ").select("rule", "law_type", "sort_order", "category")


def rules_by_risk(spark: SparkSession, d: str) -> DataFrame:
    """P7, L10 and L12: the last page of rules for all laws by risk; a page past the end is the last one."""
    k = F.col("rule")
    severity = F.when(k % 4 == 0, "RED").when(k % 4 == 1, "LOW").when(k % 4 == 2, "YELLOW").otherwise("NONE")
    ruled = worklists.rule_list(rollups.rules(spark, d), law="ALL").withColumn("severity", severity)
    return search.page(ruled.select("rule", "severity"), [worklists.by_risk(), k], 10**6, 8)


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    rules = rollups.rules(spark, d)
    return findings.renumbered(rollups.visible(spark, d), rules.select("rule", "sort_order")).join(rules.select("rule", "title", "category"), "rule", "left")


def issues_by_number(spark: SparkSession, d: str) -> DataFrame:
    wanted = worklists.preferred("severity", "default", ("RED", "YELLOW")) & (F.col("review_status") == "NEW")
    return worklists.issue_list(_numbered(spark, d), wanted, " BRAND#1 ", ["title", "category"], falling=True).select("document", "line", "number", "place")


def stored_summary(spark: SparkSession, d: str) -> DataFrame:
    return worklists.stored_summary(rollups.rollup_order(spark, d), rollups.all_findings(spark, d), "parent")


def ocr_summary(spark: SparkSession, d: str) -> DataFrame:
    confidence = F.when(F.col("l_linenumber") % 5 != 0, F.col("l_quantity").cast("double"))
    pages = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document"), (F.col("l_returnflag") == "R").alias("is_ocr"), confidence.alias("ocr_confidence"))
    return worklists.ocr_summary(pages)


def brief_rows(spark: SparkSession, d: str) -> DataFrame:
    summary = F.when(F.col("line") % 2 == 0, F.concat(F.lit("Line "), F.col("line")))
    return worklists.brief_rows(_numbered(spark, d).withColumn("summary", summary))


def annotated_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each finding has boxes on the pages around its own, none on every second of them; documents have 30 pages."""
    page, line = F.col("page"), F.col("line")
    block = lambda at, n: F.struct(at.alias("page"), F.slice(F.array(F.array(line, page, line + 10, page + 5)), F.lit(1), n).alias("rects"))
    marked = rollups.visible(spark, d).withColumn("highlights", F.array(block(page - 25, (line % 2).cast("int")), block(page + 1, F.lit(1)))).withColumn("quote_verified", line % 3 > 0)
    noted = worklists.annotated_rows(marked, F.lit(30))
    return noted.select("document", "line", "severity", "note_page", F.size("highlights").cast("long").alias("n"))


def clause_labels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    title = F.when(k % 4 == 0, F.concat(F.lit("1. Terms › п. "), k)).when(k % 4 == 1, F.concat(F.lit("пп. "), k, F.lit("–"), k + 1)).when(k % 4 == 2, F.concat(k % 150, F.lit(". "), F.col("p_name"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", worklists.clause_label(F.when(k % 7 == 0, F.concat(k, F.lit(".1"))).otherwise(""), title).alias("label"))


def paragraph_findings(spark: SparkSession, d: str) -> DataFrame:
    """Lines are paragraphs, every third of them one of a clause; every fifth line is quoted, every tenth with a clause."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("document"), F.lit(1).cast("long").alias("page"), F.posexplode(F.split("text", "\n")).alias("paragraph", "text"))
    at = F.col("paragraph")
    paragraphs = lines.withColumn("clause", F.when(at % 3 == 0, (at % 7).cast("string")))
    severity = F.when(at % 15 == 0, "GREEN").otherwise("RED")
    asked = lines.where(at % 5 == 0).select("document", "page", at.alias("finding"), F.when(at % 10 == 0, (at % 11).cast("string")).alias("clause"), F.col("text").alias("quote"), severity.alias("severity"), (at % 4 != 1).alias("quote_verified"))
    found = worklists.paragraph_findings(paragraphs, asked)
    return found.select("document", F.col("finding").cast("long").alias("finding"), F.col("paragraph").cast("long").alias("paragraph"))


QUERIES = {f.__name__: f for f in (
    rule_filter, rules_by_risk, issues_by_number, stored_summary, ocr_summary, brief_rows, annotated_rows, clause_labels,
    paragraph_findings,
)}

_NUMBERED = f"""{FINDINGS}, x AS (SELECT v.*, r.title, r.category, row_number() OVER (PARTITION BY document ORDER BY {_PLACE}, coalesce(page, 1000000), coalesce(sort_order, 0), line, rule NULLS FIRST) AS n
  FROM v LEFT JOIN r USING (rule)), m AS (SELECT *, CASE WHEN severity <> 'GREEN' THEN n END AS number FROM x)"""
_TRIM = "«»\"''“”„()[]{}.,;:!?…"
_NORM = f"array_to_string(list_filter(list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> ''), lambda t: replace(replace(trim(replace(lower(t), 'ё', 'е'), '{_TRIM}'), '–', '-'), '—', '-')), lambda t: t <> ''), ' ')"
ORACLE_SQL = {
    "rule_filter": f"WITH {FINDINGS} SELECT rule, law_type, sort_order, category FROM r WHERE is_active AND law_type <> '223-FZ'",
    "rules_by_risk": f"""WITH {FINDINGS}, s AS (SELECT rule, CASE rule % 4 WHEN 0 THEN 'RED' WHEN 1 THEN 'LOW' WHEN 2 THEN 'YELLOW' ELSE 'NONE' END AS severity, count(*) OVER () AS total,
      row_number() OVER (ORDER BY CASE rule % 4 WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 1 THEN 2 ELSE 3 END, rule) - 1 AS spot FROM r WHERE law_type = 'ALL')
      SELECT rule, severity, total FROM s WHERE spot // 8 = (total - 1) // 8""",
    "issues_by_number": f"""WITH {_NUMBERED} SELECT document, line, number, row_number() OVER (PARTITION BY document ORDER BY number DESC NULLS LAST, line) AS place FROM m
      WHERE severity IN ('RED', 'YELLOW') AND review_status = 'NEW' AND contains(lower(coalesce(title, '') || ' ' || coalesce(category, '')), 'brand#1')""",
    "stored_summary": f"""WITH {DOCS}, a AS (SELECT parent, count(DISTINCT rule) AS n FROM f JOIN o USING (document) GROUP BY parent)
      SELECT d.parent, CASE WHEN d.unscored = 0 THEN d.top END AS score, coalesce(n, 0) AS rules_checked FROM
      (SELECT parent, max(score) FILTER (WHERE status = 'COMPLETED') AS top, count(*) FILTER (WHERE status = 'COMPLETED' AND score IS NULL) AS unscored FROM docs GROUP BY parent) d LEFT JOIN a USING (parent)""",
    "ocr_summary": """SELECT l_orderkey AS document, count(*) AS total_pages, count(*) FILTER (WHERE l_returnflag = 'R') > 0 AS is_scanned, count(*) FILTER (WHERE l_returnflag = 'R') AS ocr_pages,
      round_even(avg(l_quantity) FILTER (WHERE l_returnflag = 'R' AND l_linenumber % 5 <> 0), 1) AS ocr_confidence FROM lineitem GROUP BY 1""",
    "brief_rows": f"""WITH {_NUMBERED} SELECT document, line, number, severity, trim(coalesce(title, '') || '. ' || CASE WHEN line % 2 = 0 THEN 'Line ' || line ELSE '' END) AS remark,
      coalesce(CAST(page AS VARCHAR), '—') AS page FROM m WHERE severity <> 'GREEN'""",
    "annotated_rows": f"""WITH {FINDINGS}, b AS (SELECT document, line, severity, page, line % 3 > 0 AND line % 2 = 1 AND page - 25 BETWEEN 1 AND 30 AS early, line % 3 > 0 AND page + 1 BETWEEN 1 AND 30 AS late FROM v WHERE severity <> 'UNKNOWN')
      SELECT document, line, severity, CASE WHEN early THEN page - 25 WHEN late THEN page + 1 WHEN page BETWEEN 1 AND 30 THEN page END AS note_page, CAST(coalesce(early, false) AS BIGINT) + CAST(coalesce(late, false) AS BIGINT) AS n FROM b""",
    "clause_labels": """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_partkey || '.1' WHEN p_partkey % 4 = 0 THEN CAST(p_partkey AS VARCHAR) WHEN p_partkey % 4 = 1 THEN p_partkey || '–' || (p_partkey + 1)
      WHEN p_partkey % 4 = 2 AND p_partkey % 150 < 100 THEN CAST(p_partkey % 150 AS VARCHAR) END AS label FROM part""",
    "paragraph_findings": f"""WITH x AS (SELECT doc_id AS document, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS paragraph FROM documents WHERE text IS NOT NULL),
      y AS (SELECT document, paragraph, {_NORM} AS text FROM x), p AS (SELECT *, CASE WHEN paragraph % 3 = 0 THEN paragraph % 7 END AS clause FROM y),
      f AS (SELECT document, paragraph AS finding, CASE WHEN paragraph % 10 = 0 THEN paragraph % 11 END AS clause, left(text, 60) AS probe FROM y WHERE paragraph % 5 = 0 AND paragraph % 15 <> 0 AND paragraph % 4 <> 1),
      j AS (SELECT f.document, finding, min(CASE WHEN p.clause = f.clause THEN paragraph END) AS a, min(CASE WHEN probe <> '' AND contains(text, probe) THEN paragraph END) AS b FROM f JOIN p USING (document) GROUP BY 1, 2)
      SELECT document, finding, coalesce(a, b) AS paragraph FROM j WHERE coalesce(a, b) IS NOT NULL""",
}
