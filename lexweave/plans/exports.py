"""Whole reports over the driver's tables: customers are analyses, orders their documents, line items the findings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators import exports, findings, reports
from lexweave.plans import rollups
from lexweave.plans.rollups import table

Parts = tuple[DataFrame, DataFrame, DataFrame]
#: What the texts of a finding are made of.
FACTS = ("line", "rule", "page", "title", "category")


def _checked(spark: SparkSession, d: str) -> DataFrame:
    """Rolled-up documents that can be reported."""
    return rollups.rollup_order(spark, d).where("status <> 'UNSUPPORTED'")


def _seen(spark: SparkSession, d: str) -> DataFrame:
    return findings.visible_named(rollups.all_findings(spark, d), rollups.rules(spark, d))


def _gathered(spark: SparkSession, d: str) -> DataFrame:
    """``_checked`` with the rules and findings of each document, from one pass over the findings."""
    return findings.rolled_up(rollups.documents(spark, d).where("status <> 'UNSUPPORTED'"), findings.gathered(_seen(spark, d), *FACTS))


def _document() -> list[Column]:
    """The columns of ``exports.DOCUMENT``."""
    k = F.col("document")
    file = F.concat(F.lit("doc"), k, F.lit(".pdf"))
    law = F.when(k % 3 == 0, "44-FZ").when(k % 3 == 1, "223-FZ")
    return [
        file.alias("file_name"), F.when(k % 4 == 0, F.concat(F.lit("=in/"), file)).alias("relative_path"), F.col("status"),
        (k % 9 + 1).alias("total_pages"), law.alias("law_type"), F.col("score").alias("risk_score"), F.coalesce("light", F.lit("UNKNOWN")).alias("traffic_light"),
    ]


def _finding(of: Callable[[str], Column]) -> list[Column]:
    """The columns of ``exports.FINDING``."""
    line, rule, page, severity = of("line"), of("rule"), of("page"), of("severity")
    text = lambda head, of: F.concat(F.lit(head), of)
    return [
        F.when(severity != "GREEN", of("sort_index") + 1).alias("number"), severity.alias("severity"), of("category").alias("category"), F.coalesce(of("title"), F.lit("No rule")).alias("title"), F.when(line % 2 == 0, text("=Sum ", line)).alias("short_description"),
        page.alias("page_number"), F.when(line % 3 == 0, text("1.", line)).alias("clause"), F.when(page.isNotNull(), text('Line "', line)).alias("exact_quote"), text("Said\\n", line).alias("comment"),
        F.when(rule % 3 == 0, text("Change ", rule)).alias("counter_proposal"), F.when(rule % 2 == 0, text("Art. ", rule)).otherwise("").alias("legal_reference"), of("review_status").alias("review_status"), F.lit(None).cast("string").alias("reviewer_comment"),
        (line % 2 == 1).alias("quote_verified"), F.lit("HEURISTIC").alias("source"), F.when(page.isNotNull(), F.array(F.struct(page.alias("page")))).otherwise(F.array().cast("array<struct<page:bigint>>")).alias("highlights"),
    ]


def _analyses(spark: SparkSession, d: str, head: DataFrame, *more: str) -> DataFrame:
    """Customers that have a head, with the columns of ``exports.HEAD``."""
    c = F.col("c_custkey")
    return table(spark, d, "customer").join(head, F.col("parent") == c).select(
        c.alias("analysis"), F.when(c % 2 == 0, "detailed").otherwise("brief").alias("mode"), F.col("c_name").alias("title"), F.concat("c_name", F.when(c % 3 == 0, ".zip").otherwise(".pdf")).alias("original_filename"),
        F.lit("2024-01-01T00:00:00+00:00").alias("generated_at"), F.when(c % 5 > 0, F.concat(F.lit('A "quoted" '), c)).alias("author"), F.col("c_mktsegment").alias("company"),
        F.col("light").alias("traffic_light"), F.col("score").alias("risk_score"), "rules_checked", *more,
    )


def _head(docs: DataFrame, *more: Column) -> DataFrame:
    """What an analysis has of its documents; a rule that two of them share counts once."""
    used = F.size(F.array_distinct(F.flatten(F.collect_list("rules")))).cast("long")
    return reports.assessment(docs, "parent", used.alias("used"), *more).withColumn("rules_checked", F.col("used"))


def report_parts(spark: SparkSession, d: str) -> Parts:
    docs, seen = _gathered(spark, d), _seen(spark, d)
    documents = docs.select(F.col("parent").alias("analysis"), "document", *_document())
    rows = findings.numbered(seen).where("review_status <> 'DISMISSED'").select("document", F.col("sort_index").alias("place"), *_finding(F.col))
    return _analyses(spark, d, _head(docs.repartition("parent"))), documents, rows


def json_reports(spark: SparkSession, d: str) -> DataFrame:
    """Findings are shuffled by document and by analysis, and by rule if rules are too many to be sent everywhere; heads and
    texts come from the same rows."""
    docs = _gathered(spark, d).repartition("parent")
    facts = docs.select("parent", "document", *_document(), "score", *findings.COUNTS, "rules", "findings")
    whole = _analyses(spark, d, _head(facts, F.collect_list(exports.whole_document()).alias("reported")), "reported")
    return exports.whole_reports(whole, lambda f: _finding(f.getField)).select("analysis", "n_documents", F.sha2("json", 256).alias("digest"))


def _placed(rows: DataFrame) -> DataFrame:
    return rows.select("analysis", "block", "document", "part", "place", F.sha2("text", 256).alias("digest"))


def json_fragments(spark: SparkSession, d: str) -> DataFrame:
    return _placed(exports.json_fragments(*report_parts(spark, d)))


def csv_report(spark: SparkSession, d: str) -> DataFrame:
    return exports.csv_lines(*report_parts(spark, d)).select("analysis", "block", "document", "place", "text")


def rules_appendix(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("rule")
    severity = F.when(k % 4 == 0, "RED").when(k % 4 == 1, "LOW").otherwise("YELLOW")
    listed = rollups.rules(spark, d).select("rule", "sort_order", "title", "category", severity.alias("severity"), F.when(k % 2 == 0, F.concat(F.lit("Art. "), k)).otherwise("").alias("reference"))
    docs = _checked(spark, d).select("document", F.col("parent").alias("analysis"))
    return exports.rules_appendix(docs, rollups.visible(spark, d), listed)


QUERIES = {f.__name__: f for f in (json_reports, json_fragments, csv_report, rules_appendix)}

_PLACE = "CASE severity WHEN 'RED' THEN 0 WHEN 'YELLOW' THEN 1 WHEN 'LOW' THEN 2 WHEN 'UNKNOWN' THEN 3 ELSE 4 END"
_LIGHT = "CASE WHEN critical > 0 THEN 'RED' WHEN warning > 0 THEN 'YELLOW' WHEN unknown > 0 THEN 'UNKNOWN' ELSE 'GREEN' END"
_PARTS = rf"""{rollups.DOCS},
 dd AS (SELECT parent AS analysis, document, CASE WHEN document % 4 = 0 THEN '=in/doc' || document || '.pdf' END AS relative_path, 'doc' || document || '.pdf' AS file_name, status, document % 9 + 1 AS total_pages,
   CASE document % 3 WHEN 0 THEN '44-FZ' WHEN 1 THEN '223-FZ' END AS law_type, score AS risk_score, coalesce(light, 'UNKNOWN') AS traffic_light, critical, warning, unknown, rules_checked AS own_rules FROM docs WHERE status <> 'UNSUPPORTED'),
 ru AS (SELECT analysis, count(DISTINCT rule) AS rules_checked FROM v JOIN dd USING (document) GROUP BY analysis),
 hx AS (SELECT analysis, count(*) AS n, count(*) FILTER (WHERE NOT (status = 'COMPLETED' AND own_rules > 0)) AS open, max(risk_score) AS top, count(*) FILTER (WHERE status = 'COMPLETED' AND own_rules > 0 AND risk_score IS NULL) AS unscored,
   sum(critical) AS critical, sum(warning) AS warning, sum(unknown) AS unknown, arg_min({{'document': document, 'file_name': file_name, 'relative_path': relative_path}}, (coalesce(relative_path, ''), document)) AS first FROM dd GROUP BY analysis),
 hd AS (SELECT analysis, CASE WHEN analysis % 2 = 0 THEN 'detailed' ELSE 'brief' END AS mode, c_name AS title, c_name || CASE WHEN analysis % 3 = 0 THEN '.zip' ELSE '.pdf' END AS original_filename, '2024-01-01T00:00:00+00:00' AS generated_at,
   CASE WHEN analysis % 5 > 0 THEN 'A "quoted" ' || analysis END AS author, c_mktsegment AS company, CASE WHEN open > 0 THEN 'UNKNOWN' ELSE {_LIGHT} END AS traffic_light, CASE WHEN open = 0 AND unscored = 0 THEN top END AS risk_score,
   CAST(coalesce(rules_checked, 0) AS BIGINT) AS rules_checked, n, first FROM hx JOIN customer ON c_custkey = analysis LEFT JOIN ru USING (analysis)),
 nf AS (SELECT v.*, r.title, category, row_number() OVER (PARTITION BY document ORDER BY {_PLACE}, coalesce(page, 1000000), coalesce(sort_order, 0), line, v.rule NULLS FIRST, review_status) - 1 AS place FROM v LEFT JOIN r ON r.rule = v.rule),
 ff AS (SELECT document, place, CASE WHEN severity <> 'GREEN' THEN place + 1 END AS number, severity, category, coalesce(title, 'No rule') AS title, CASE WHEN line % 2 = 0 THEN '=Sum ' || line END AS short_description, page AS page_number,
   CASE WHEN line % 3 = 0 THEN '1.' || line END AS clause, CASE WHEN page IS NOT NULL THEN 'Line "' || line END AS exact_quote, 'Said\n' || line AS comment, CASE WHEN rule % 3 = 0 THEN 'Change ' || rule END AS counter_proposal,
   CASE WHEN rule % 2 = 0 THEN 'Art. ' || rule ELSE '' END AS legal_reference, review_status, CAST(NULL AS VARCHAR) AS reviewer_comment, line % 2 = 1 AS quote_verified, 'HEURISTIC' AS source,
   CASE WHEN page IS NOT NULL THEN [{{'page': page}}] ELSE [] END AS highlights FROM nf WHERE review_status <> 'DISMISSED'),
 sf AS (SELECT ff.*, dd.analysis, coalesce(relative_path, '') AS path, file_name, relative_path FROM ff JOIN dd USING (document) JOIN hd USING (analysis) WHERE mode = 'detailed' OR severity <> 'GREEN')"""
_S = lambda names, first="": "{" + first + ", ".join(f"'{c}': {c}" for c in names) + "}"
_ITEM = _S(exports.FINDING)
_DOC = _S(exports.DOCUMENT, "'id': CAST(document AS VARCHAR), ")
_HEAD = "{'mode': mode, 'analysis_id': CAST(analysis AS VARCHAR), " + _S(exports.HEAD[1:])[1:]
_TARGET = "{'id': CAST(first.document AS VARCHAR), 'file_name': first.file_name, 'relative_path': first.relative_path}"
_OPEN = lambda json, name: f"(left(CAST(to_json({json}) AS VARCHAR), length(CAST(to_json({json}) AS VARCHAR)) - 1) || ',\"{name}\":[')"
_CELL = lambda c: f"'\"' || replace(coalesce(CASE WHEN regexp_matches({c}, '^(?:[\\s\\x00-\\x1f]*[=+\\-@]|[\\t\\r\\n])') THEN '''' || {c} ELSE {c} END, ''), '\"', '\"\"') || '\"'"
_LINE = lambda *cells: " || ';' || ".join(_CELL(c) for c in cells)
_CASE = lambda c, names: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE {c} END"
_ARCHIVE, _FILE = f"'{reports.SOURCE_ARCHIVE}'", f"'{reports.SOURCE_FILE}'"
_PREAMBLE = [
    f"CASE WHEN n = 1 THEN {_LINE(repr(exports.ONE_FILE), 'coalesce(first.relative_path, first.file_name)')} ELSE {_LINE(_ARCHIVE, 'original_filename')} END",
    f"CASE WHEN n = 1 THEN {_LINE(_ARCHIVE, 'original_filename')} ELSE {_LINE(repr(exports.SEVERAL), 'CAST(n AS VARCHAR)')} END",
    _LINE(repr(exports.MODE), f"({_CASE('mode', exports.MODES)})"), _LINE(repr(exports.AUTHOR), "coalesce(author, '—')"), _LINE(repr(exports.COMPANY), "company"),
    _LINE(repr(exports.SCORE), "CAST(risk_score AS VARCHAR)"), _LINE(repr(exports.RULES), "CAST(rules_checked AS VARCHAR)"), "''", _LINE(*map(repr, exports.TITLES)),
]
_CELLS = ["coalesce(relative_path, file_name)", "CAST(number AS VARCHAR)", f"({_CASE('severity', exports.LEVELS)})", "title", "short_description", "clause", "CAST(page_number AS VARCHAR)", "exact_quote", "counter_proposal", "legal_reference", f"({_CASE('review_status', exports.REVIEWS)})"]
ORACLE_SQL = {
    "json_reports": f"""WITH {_PARTS}, i AS (SELECT document, list({_ITEM} ORDER BY place) AS findings FROM sf GROUP BY document),
      w AS (SELECT dd.analysis, coalesce(relative_path, '') AS path, document, {_DOC[:-1]}, 'findings': coalesce(findings, [])}} AS item FROM dd LEFT JOIN i USING (document)),
      g AS (SELECT analysis, list(item ORDER BY path, document) AS documents FROM w GROUP BY analysis)
      SELECT analysis, n AS n_documents, sha256(CAST(CASE WHEN n = 1 THEN to_json({_HEAD[:-1]}, 'documents': documents, 'target_document': {_TARGET}}}) ELSE to_json({_HEAD[:-1]}, 'documents': documents}}) END AS VARCHAR)) AS digest FROM hd JOIN g USING (analysis)""",
    "json_fragments": f"""WITH {_PARTS}, x AS (SELECT analysis, 0 AS block, first.document AS document, 0 AS part, 0 AS place, {_OPEN(_HEAD, "documents")} AS text FROM hd
      UNION ALL SELECT analysis, 1, document, 0, 0, CASE WHEN document = first.document THEN '' ELSE ',' END || {_OPEN(_DOC.replace("'risk_score': ", "'risk_score': dd.").replace("'traffic_light': ", "'traffic_light': dd."), "findings")} FROM dd JOIN (SELECT analysis, first FROM hd) USING (analysis)
      UNION ALL SELECT analysis, 1, document, 1, place, CASE WHEN place = min(place) OVER (PARTITION BY document) THEN '' ELSE ',' END || CAST(to_json({_ITEM}) AS VARCHAR) FROM sf
      UNION ALL SELECT analysis, 1, document, 2, 0, ']}}' FROM dd UNION ALL SELECT analysis, 2, first.document, 0, 0, CASE WHEN n = 1 THEN '],"target_document":' || CAST(to_json({_TARGET}) AS VARCHAR) || '}}' ELSE ']}}' END FROM hd)
      SELECT analysis, block, document, part, place, sha256(text) AS digest FROM x""",
    "csv_report": f"""WITH {_PARTS}, p AS (SELECT analysis, first.document AS document, unnest([{", ".join(_PREAMBLE)}]) AS line, unnest(range({len(_PREAMBLE)})) AS place FROM hd)
      SELECT analysis, 0 AS block, document, place, CASE WHEN place = 0 THEN chr(65279) ELSE '' END || line AS text FROM p UNION ALL SELECT analysis, 1, document, place, {_LINE(*_CELLS)} FROM sf""",
    "rules_appendix": f"""WITH {_PARTS} SELECT analysis, sort_order, u.rule, title, category, CASE WHEN u.rule % 4 = 0 THEN 'RED' WHEN u.rule % 4 = 1 THEN 'LOW' ELSE 'YELLOW' END AS level,
      CASE WHEN u.rule % 2 = 0 THEN 'Art. ' || u.rule ELSE '—' END AS reference FROM (SELECT DISTINCT analysis, rule FROM v JOIN dd USING (document)) u JOIN r ON r.rule = u.rule""",
}
