"""Relational queries over the driver's tables: line items are findings, parts are rules, orders are documents,
customers are files, nations are projects, events are the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators import context, findings, quotes, reports, search
from lexweave.streaming import feeds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def all_findings(spark: SparkSession, d: str) -> DataFrame:
    return findings.findings_of_lines(table(spark, d, "lineitem"))


def rules(spark: SparkSession, d: str) -> DataFrame:
    return findings.rules_of_parts(table(spark, d, "part"))


def visible(spark: SparkSession, d: str) -> DataFrame:
    return findings.visible(all_findings(spark, d), rules(spark, d))


def documents(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(k % 97 == 0, "UNSUPPORTED").when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", F.when(k % 5 == 0, "OCR").when(k % 5 < 3, "ANALYZING").otherwise("COMPLETED")).otherwise("FAILED")
    return table(spark, d, "orders").select(k.alias("document"), F.col("o_custkey").alias("parent"), status.alias("status"), (k % 100).alias("progress"))


FINDINGS = """
f AS (SELECT l_orderkey AS document, CAST(l_linenumber AS BIGINT) AS line, CASE WHEN l_suppkey % 11 <> 0 THEN l_partkey END AS rule,
  CASE WHEN l_discount >= 0.09 AND l_tax >= 0.06 THEN 'RED' WHEN l_discount >= 0.07 THEN 'YELLOW' WHEN l_quantity >= 40 THEN 'LOW'
    WHEN l_returnflag = 'R' AND l_quantity < 2 THEN 'UNKNOWN' ELSE 'GREEN' END AS severity,
  CASE l_suppkey % 7 WHEN 0 THEN 'DISMISSED' WHEN 1 THEN 'CONFIRMED' WHEN 2 THEN 'RESOLVED' ELSE 'NEW' END AS review_status,
  CASE WHEN l_quantity >= 5 THEN CAST(l_quantity AS BIGINT) END AS page FROM lineitem),
r AS (SELECT p_partkey AS rule, p_size % 10 <> 0 AS is_active, CASE p_size % 3 WHEN 0 THEN 'ALL' WHEN 1 THEN '44-FZ' ELSE '223-FZ' END AS law_type,
  CAST(p_size AS BIGINT) AS sort_order, p_name AS title, p_brand AS category FROM part),
v AS (SELECT f.* FROM f WHERE rule IS NULL OR rule NOT IN (SELECT rule FROM r WHERE NOT is_active))"""
_COUNTS = """CAST(count(*) FILTER (WHERE severity = 'RED' AND review_status <> 'DISMISSED') AS BIGINT) AS critical,
  CAST(count(*) FILTER (WHERE severity = 'YELLOW' AND review_status <> 'DISMISSED') AS BIGINT) AS warning,
  CAST(count(*) FILTER (WHERE severity = 'LOW' AND review_status <> 'DISMISSED') AS BIGINT) AS low,
  CAST(count(*) FILTER (WHERE severity = 'UNKNOWN' AND review_status <> 'DISMISSED') AS BIGINT) AS unknown,
  CAST(count(*) FILTER (WHERE severity = 'GREEN') AS BIGINT) AS ok,
  CAST(count(*) FILTER (WHERE severity <> 'GREEN' AND review_status = 'NEW') AS BIGINT) AS unseen,
  count(DISTINCT rule) AS rules_checked"""
COUNTED = f"{FINDINGS},\nc AS (SELECT document, {_COUNTS} FROM v GROUP BY document)"
_SCORE = "CASE WHEN unknown = 0 THEN CAST(round(100 * (1 - pow(0.7, critical) * pow(0.9, warning) * pow(0.97, low))) AS BIGINT) END"
_LIGHT = "CASE WHEN critical > 0 THEN 'RED' WHEN warning > 0 THEN 'YELLOW' WHEN unknown > 0 THEN 'UNKNOWN' ELSE 'GREEN' END"
_NAMES = ("critical", "warning", "low", "ok", "unknown", "unseen", "rules_checked")
_ZEROS = ", ".join(f"coalesce({n}, 0) AS {n}" for n in _NAMES)
DOCS = f"""{COUNTED},
o AS (SELECT o_orderkey AS document, o_custkey AS parent, o_orderkey % 100 AS progress, CASE WHEN o_orderkey % 97 = 0 THEN 'UNSUPPORTED'
  WHEN o_orderstatus = 'F' THEN 'COMPLETED' WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'OCR' WHEN o_orderkey % 5 < 3 THEN 'ANALYZING' ELSE 'COMPLETED' END
  ELSE 'FAILED' END AS status FROM orders),
oc AS (SELECT o.*, {_ZEROS} FROM o LEFT JOIN c USING (document)),
docs AS (SELECT *, CASE WHEN status = 'COMPLETED' AND (rules_checked > 0 OR critical + warning + low + unknown + ok > 0) THEN {_LIGHT} END AS light,
  CASE WHEN status = 'COMPLETED' AND (rules_checked > 0 OR critical + warning + low + unknown + ok > 0) THEN {_SCORE} END AS score,
  CASE status WHEN 'COMPLETED' THEN 'ready' WHEN 'FAILED' THEN 'failed' WHEN 'UNSUPPORTED' THEN 'failed' ELSE 'processing' END AS phase FROM oc)"""
FILES = f"""{DOCS},
fc AS (SELECT parent, {_COUNTS} FROM v JOIN o USING (document) GROUP BY parent),
fd AS (SELECT parent, count(*) FILTER (WHERE t) AS documents,
    CAST(coalesce(round_even(avg(CASE WHEN t THEN CASE WHEN e THEN 100 ELSE progress END END), 0), 100) AS BIGINT) AS progress,
    min(CASE WHEN t AND NOT e THEN CASE status WHEN 'OCR' THEN 2 ELSE 4 END END) AS rank, count(*) FILTER (WHERE t AND status = 'COMPLETED') AS completed,
    count(*) FILTER (WHERE t AND score IS NULL) AS unscored, max(CASE WHEN t THEN score END) AS top, count(*) FILTER (WHERE t AND NOT e) AS active,
    count(*) FILTER (WHERE t AND light IS NULL) AS unlit
  FROM (SELECT *, status <> 'UNSUPPORTED' AS t, status IN ('COMPLETED', 'FAILED', 'UNSUPPORTED') AS e FROM docs) GROUP BY parent),
files AS (SELECT parent, documents, progress, CASE WHEN documents = 0 THEN 'FAILED' WHEN rank = 2 THEN 'OCR' WHEN rank = 4 THEN 'ANALYZING' WHEN completed > 0 THEN 'COMPLETED' ELSE 'FAILED' END AS stage,
    active, CASE WHEN active = 0 AND documents > 0 AND unscored = 0 THEN top END AS score,
    CASE WHEN active = 0 AND documents > 0 AND unlit = 0 THEN {_LIGHT} END AS light, {", ".join(_NAMES)}
  FROM (SELECT fd.*, {_ZEROS} FROM fd LEFT JOIN fc USING (parent)))"""


def severity_counts(spark: SparkSession, d: str) -> DataFrame:
    return findings.severity_counts(visible(spark, d), "document")


def risk_score(spark: SparkSession, d: str) -> DataFrame:
    return severity_counts(spark, d).select("document", findings.score().alias("score"))


def traffic_light(spark: SparkSession, d: str) -> DataFrame:
    return severity_counts(spark, d).select("document", findings.light().alias("light"))


def rollup_order(spark: SparkSession, d: str) -> DataFrame:
    return findings.document_rollup(documents(spark, d), visible(spark, d)).select("document", "parent", "status", "phase", "light", "score", *findings.COUNTS)


def _files(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    by_file = findings.severity_counts(visible(spark, d).join(docs.select("document", "parent"), "document"), "parent")
    return findings.file_rollup(findings.document_rollup(docs, visible(spark, d)), by_file)


def rollup_customer(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d)


def rollup_nation(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "customer").select(F.col("c_custkey").alias("parent"), F.col("c_nationkey").alias("project"))
    return findings.project_rollup(_files(spark, d).join(nations, "parent"), "project")


def severity_pivot(spark: SparkSession, d: str) -> DataFrame:
    return findings.severity_pivot(visible(spark, d), "document")


def review_counts(spark: SparkSession, d: str) -> DataFrame:
    return findings.review_counts(visible(spark, d), "document")


def findings_grouped(spark: SparkSession, d: str) -> DataFrame:
    return findings.grouped_by_severity(visible(spark, d), "document").select("document", "severity", "n", F.array_join("lines", ",").alias("lines"))


def distinct_categories(spark: SparkSession, d: str) -> DataFrame:
    named = visible(spark, d).join(rules(spark, d).select("rule", "category"), "rule").where("category <> ''")
    return named.groupBy("document").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))


def visible_findings(spark: SparkSession, d: str) -> DataFrame:
    return visible(spark, d).select("document", "line", "rule")


def applicable_rules(spark: SparkSession, d: str) -> DataFrame:
    law = F.when(F.col("n_nationkey") % 3 == 1, "44-FZ").when(F.col("n_nationkey") % 3 == 2, "223-FZ")
    return findings.applicable_rules(table(spark, d, "nation").select(F.col("n_nationkey").alias("document"), law.alias("law")), rules(spark, d)).select("document", "rule")


def rules_used(spark: SparkSession, d: str) -> DataFrame:
    critical = visible(spark, d).where("severity = 'RED'").select("rule")
    return rules(spark, d).join(critical, "rule", "left_semi").select("rule", "sort_order", "title")


def page_and_total(spark: SparkSession, d: str) -> DataFrame:
    return search.page(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.col("o_orderkey")], 2, 8)


def history_page(spark: SparkSession, d: str) -> DataFrame:
    return search.history(table(spark, d, "events"), "event_type", [" signup ", "Error"]).select("event_id", "ts", "user_id", "title", F.get_json_object("props", "$.k").cast("long").alias("k"))


def multi_ilike_search(spark: SparkSession, d: str) -> DataFrame:
    return search.matching(table(spark, d, "documents"), "token = ", ["text", "lang", "source"]).select("doc_id", "lang", "source")


def project_search(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_name")
    return search.parents_matching(table(spark, d, "nation"), customers, "n_nationkey", "00012", "n_name", "c_name").select("n_nationkey", "n_name")


def new_uploads_anti(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars", "lang")
    return search.new_uploads(docs.where("lang IN ('en', 'fr')"), docs.where("lang NOT IN ('en', 'fr')"), ["source", "n_chars"], "doc_id").select("doc_id", "source", "n_chars")


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    return search.latest(table(spark, d, "events").select("user_id", "event_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"])


def repeated_titles(spark: SparkSession, d: str) -> DataFrame:
    return search.repeated_titles(table(spark, d, "part"), "p_brand", "p_name")


def renumber_findings(spark: SparkSession, d: str) -> DataFrame:
    return findings.renumbered(visible(spark, d), rules(spark, d)).select("document", "line", "sort_index", "number")


def last_n_messages(spark: SparkSession, d: str) -> DataFrame:
    return context.last_messages(table(spark, d, "conversations"), "conv_id", ["turn", "role", "text"], 3).select("conv_id", "turn", "role", "place")


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    phase = F.when(kind == "purchase", "ready").when(kind == "error", "failed").otherwise("processing")
    return table(spark, d, "events").select("user_id", "ts", "event_id", phase.alias("phase"), F.when(kind == "error", F.lit("failed")).alias("error"), F.floor(F.col("value") / 50).alias("critical"))


def lag_notifications(spark: SparkSession, d: str) -> DataFrame:
    return feeds.notifications(_snapshots(spark, d), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "kind")


def status_changes(spark: SparkSession, d: str) -> DataFrame:
    return feeds.changes(_snapshots(spark, d), "user_id", ["ts", "event_id"], "phase").select("user_id", "event_id", "before", "phase")


def events_windows(spark: SparkSession, d: str) -> DataFrame:
    found = feeds.event_windows(table(spark, d, "events"), "ts", "event_type", "value", "1 hour")
    return found.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 3).alias("total"))


def state_transitions(spark: SparkSession, d: str) -> DataFrame:
    after = findings.transition(F.col("status"), F.col("document") % 2 == 0)
    return documents(spark, d).select("document", "status", after.alias("after"))


def state_facets(spark: SparkSession, d: str) -> DataFrame:
    """A22, P23: files by state, states without files included."""
    files = documents(spark, d).groupBy("parent").agg(*[F.bool_or(F.col("status").isin(*s)).alias(n) for n, s in (("processing", ("OCR", "ANALYZING")), ("failed", ("FAILED", "UNSUPPORTED")))])
    state = F.when(F.col("processing"), "processing").when(F.col("failed"), "failed").otherwise("ready")
    counts = files.groupBy(state.alias("state")).agg(F.count("*").alias("n"))
    states = spark.createDataFrame([("processing",), ("failed",), ("ready",), ("empty",)], "state string")
    return states.join(counts, "state", "left").fillna(0, ["n"])


def box_union(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("l_partkey") % 500, F.col("l_suppkey") % 700
    words = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document"), (F.col("l_linenumber") % 2).cast("long").alias("page"), (F.col("l_linenumber") % 3).cast("long").alias("line"), x.alias("x0"), y.alias("y0"), (x + F.col("l_quantity").cast("long")).alias("x1"), (y + 10).alias("y1"))
    return quotes.box_union(words)


def protocol_rows(spark: SparkSession, d: str) -> DataFrame:
    """Findings with a page have a quote, those of every third rule a proposal, of every second one a reference."""
    name = lambda text, c: F.concat(F.lit(text), F.col(c).cast("string"))
    said = visible(spark, d).withColumn("quote", F.when(F.col("page").isNotNull(), name("Line ", "line"))).withColumn("proposal", F.when(F.col("rule") % 3 == 0, name("Change ", "rule")))
    told = said.withColumn("comment", name("Page ", "page")).withColumn("reference", F.when(F.col("rule") % 2 == 0, name("Art. ", "rule")).otherwise(""))
    return findings.protocol_rows(told, rules(spark, d), documents(spark, d))


def report_detailed(spark: SparkSession, d: str) -> DataFrame:
    return findings.lists_for_reports(visible(spark, d), rules(spark, d)).select("document", "line", "part", "severity", "title")


def report_assessment(spark: SparkSession, d: str) -> DataFrame:
    return reports.assessment(rollup_order(spark, d), "parent").select("parent", "documents", "open", "score", "light", "rules_checked")


def annotated_allowed(spark: SparkSession, d: str) -> DataFrame:
    return reports.annotated_allowed(rollup_order(spark, d), "parent")


def json_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.nested_json(visible(spark, d), "document", ["line", "rule", "severity", "review_status"], ["line"])


def result_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return context.fingerprint(visible(spark, d), "document", ["line", "rule", "severity", "review_status"])


def name_projections(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("c_name")
    return table(spark, d, "customer").select("c_custkey", search.initials(F.replace(name, F.lit("#"), F.lit(" x"))).alias("initials"), search.basename(F.concat(F.lit("in/"), name, F.lit(".PDF"))).alias("base"), search.renamed(F.concat(F.lit("n"), F.col("c_custkey")), F.lit("old/a.PDF")).alias("renamed"), reports.slug(name).alias("slug"), search.natural_key(name).alias("sort_key"))


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """K9: findings left after the projects of one region are deleted, and their files and documents with them."""
    from lexweave.sources.uploads import without

    gone = table(spark, d, "nation").where("n_regionkey = 1").select("n_nationkey")
    customers = without(table(spark, d, "customer"), gone, "c_nationkey", "n_nationkey")
    kept = table(spark, d, "customer").join(customers.select("c_custkey"), "c_custkey", "left_anti")
    orders = without(table(spark, d, "orders"), kept, "o_custkey", "c_custkey")
    lost = table(spark, d, "orders").join(orders.select("o_orderkey"), "o_orderkey", "left_anti")
    return without(all_findings(spark, d), lost, "document", "o_orderkey").select("document", "line")


QUERIES = {f.__name__: f for f in (
    severity_counts, risk_score, traffic_light, rollup_order, rollup_customer, rollup_nation, severity_pivot, review_counts,
    findings_grouped, distinct_categories, visible_findings, applicable_rules, rules_used, page_and_total, history_page,
    multi_ilike_search, project_search, new_uploads_anti, upsert_latest, repeated_titles, renumber_findings, last_n_messages,
    lag_notifications, status_changes, events_windows, state_transitions, state_facets, box_union, protocol_rows,
    report_detailed, report_assessment, annotated_allowed, json_report, result_fingerprint, name_projections, cascade_delete,
)}

_PLACE = "CASE severity WHEN 'RED' THEN 0 WHEN 'YELLOW' THEN 1 WHEN 'LOW' THEN 2 WHEN 'UNKNOWN' THEN 3 ELSE 4 END"
_SNAP = """s AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'purchase' THEN 'ready' WHEN 'error' THEN 'failed' ELSE 'processing' END AS phase,
  event_type = 'error' AS failed, floor(value / 50) AS critical FROM events),
p AS (SELECT *, lag(phase) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM s)"""
ORACLE_SQL = {
    "severity_counts": f"WITH {COUNTED} SELECT * FROM c",
    "risk_score": f"WITH {COUNTED} SELECT document, {_SCORE} AS score FROM c",
    "traffic_light": f"WITH {COUNTED} SELECT document, {_LIGHT} AS light FROM c",
    "rollup_order": f"WITH {DOCS} SELECT document, parent, status, phase, light, score, {', '.join(_NAMES)} FROM docs",
    "rollup_customer": f"WITH {FILES} SELECT * FROM files",
    "rollup_nation": f"""WITH {FILES}, n AS (SELECT c_nationkey AS project, count(*) AS files, count(*) FILTER (WHERE active > 0) AS processing_count,
      count(*) FILTER (WHERE light IS NULL) AS unlit, {", ".join(f"CAST(sum({x}) AS BIGINT) AS {x}" for x in _NAMES)} FROM files JOIN customer ON parent = c_custkey GROUP BY c_nationkey)
      SELECT project, files, processing_count, {", ".join(_NAMES)}, CASE WHEN unlit = 0 THEN {_LIGHT} END AS light FROM n""",
    "severity_pivot": f"""WITH {FINDINGS} SELECT document, count(*) FILTER (WHERE severity = 'RED') AS RED, count(*) FILTER (WHERE severity = 'YELLOW') AS YELLOW,
      count(*) FILTER (WHERE severity = 'LOW') AS LOW FROM v GROUP BY document""",
    "review_counts": f"""WITH {FINDINGS}, x AS (SELECT document, count(*) AS total, count(*) FILTER (WHERE review_status = 'NEW') AS unseen,
      count(*) FILTER (WHERE review_status IN ('CONFIRMED', 'RESOLVED')) AS accepted, count(*) FILTER (WHERE review_status = 'DISMISSED') AS dismissed FROM v WHERE severity <> 'GREEN' GROUP BY document)
      SELECT *, CAST(round(100 * (accepted + dismissed) / total) AS BIGINT) AS reviewed_percent FROM x""",
    "findings_grouped": f"""WITH {FINDINGS} SELECT k.document, k.severity, count(v.line) AS n, coalesce(string_agg(CAST(v.line AS VARCHAR), ',' ORDER BY v.line), '') AS lines
      FROM (SELECT * FROM (SELECT DISTINCT document FROM v), (VALUES ('RED'), ('YELLOW'), ('LOW'), ('UNKNOWN'), ('GREEN')) s(severity)) k
      LEFT JOIN v ON v.document = k.document AND v.severity = k.severity GROUP BY 1, 2""",
    "distinct_categories": f"WITH {FINDINGS} SELECT document, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM v JOIN r USING (rule) WHERE category <> '' GROUP BY document",
    "visible_findings": f"WITH {FINDINGS} SELECT document, line, rule FROM v",
    "applicable_rules": f"""WITH {FINDINGS} SELECT n_nationkey AS document, rule FROM nation JOIN r ON is_active AND
      (n_nationkey % 3 = 0 OR law_type = 'ALL' OR law_type = CASE n_nationkey % 3 WHEN 1 THEN '44-FZ' ELSE '223-FZ' END)""",
    "rules_used": f"WITH {FINDINGS} SELECT rule, sort_order, title FROM r WHERE rule IN (SELECT rule FROM v WHERE severity = 'RED')",
    "page_and_total": "SELECT o_orderkey, o_orderdate, count(*) OVER () AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 8 OFFSET 16",
    "history_page": "SELECT event_id, ts, user_id, event_type AS title, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type IN ('signup', 'error')",
    "multi_ilike_search": "SELECT doc_id, lang, source FROM documents WHERE text ILIKE '%token = %' OR lang ILIKE '%token = %' OR source ILIKE '%token = %'",
    "project_search": "SELECT n_nationkey, n_name FROM nation WHERE n_name ILIKE '%00012%' OR n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_name ILIKE '%00012%')",
    "new_uploads_anti": """SELECT min(doc_id) AS doc_id, source, n_chars FROM documents d WHERE lang IN ('en', 'fr')
      AND NOT EXISTS (SELECT 1 FROM documents e WHERE e.lang NOT IN ('en', 'fr') AND e.source = d.source AND e.n_chars = d.n_chars) GROUP BY source, n_chars""",
    "upsert_latest": "SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "repeated_titles": "SELECT p_brand, lower(p_name) AS title FROM part GROUP BY 1, 2 HAVING count(*) > 1",
    "renumber_findings": f"""WITH {FINDINGS}, x AS (SELECT document, line, severity, row_number() OVER (PARTITION BY document ORDER BY {_PLACE}, coalesce(page, 1000000), coalesce(sort_order, 0), line, rule NULLS FIRST) - 1 AS sort_index
      FROM v LEFT JOIN r USING (rule)) SELECT document, line, sort_index, CASE WHEN severity <> 'GREEN' THEN sort_index + 1 END AS number FROM x""",
    "last_n_messages": """SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place FROM
      (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS n FROM conversations) WHERE n <= 3""",
    "lag_notifications": f"""WITH {_SNAP} SELECT user_id, event_id, CASE WHEN failed THEN 'error' WHEN critical > 0 THEN 'critical' ELSE 'ready' END AS kind
      FROM p WHERE previous = 'processing' AND phase <> 'processing'""",
    "status_changes": f"WITH {_SNAP} SELECT user_id, event_id, previous AS before, phase FROM p WHERE previous IS DISTINCT FROM phase",
    "events_windows": "SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2",
    "state_transitions": f"WITH {DOCS} SELECT document, status, CASE status WHEN 'COMPLETED' THEN 'ANALYZING' WHEN 'FAILED' THEN 'QUEUED' END AS after FROM docs",
    "state_facets": f"""WITH {DOCS}, x AS (SELECT CASE WHEN bool_or(status IN ('OCR', 'ANALYZING')) THEN 'processing' WHEN bool_or(status IN ('FAILED', 'UNSUPPORTED')) THEN 'failed' ELSE 'ready' END AS state FROM docs GROUP BY parent)
      SELECT s.state, count(x.state) AS n FROM (VALUES ('processing'), ('failed'), ('ready'), ('empty')) s(state) LEFT JOIN x ON x.state = s.state GROUP BY 1""",
    "box_union": """SELECT l_orderkey AS document, CAST(l_linenumber % 2 AS BIGINT) AS page, CAST(l_linenumber % 3 AS BIGINT) AS line, min(l_partkey % 500) AS x0, min(l_suppkey % 700) AS y0,
      max(l_partkey % 500 + CAST(l_quantity AS BIGINT)) AS x1, max(l_suppkey % 700 + 10) AS y1 FROM lineitem GROUP BY 1, 2, 3""",
    "protocol_rows": f"""WITH {FINDINGS} SELECT o_custkey AS parent, row_number() OVER (PARTITION BY o_custkey ORDER BY document, {_PLACE}, coalesce(page, 1000000), coalesce(sort_order, 0), line, rule NULLS FIRST) AS number, document, line,
      CASE WHEN page IS NULL THEN 'Условие отсутствует' ELSE 'Line ' || line END AS quote, CASE WHEN rule % 3 = 0 THEN 'Change ' || rule ELSE 'Просим уточнить / исключить условие' END AS proposal,
      coalesce('Page ' || page, '') || CASE WHEN rule % 2 = 0 THEN ' (Art. ' || rule || ')' ELSE '' END AS reason
      FROM v LEFT JOIN r USING (rule) JOIN orders ON o_orderkey = document WHERE severity IN ('RED', 'YELLOW', 'LOW') AND (page IS NOT NULL OR rule % 3 = 0)""",
    "report_detailed": f"""WITH {FINDINGS}, n AS (SELECT v.*, coalesce(title, 'No rule') AS title FROM v LEFT JOIN r USING (rule))
      SELECT document, line, CASE WHEN severity = 'GREEN' THEN 'clean' ELSE 'issue' END AS part, severity, title FROM n
      WHERE severity <> 'GREEN' OR NOT EXISTS (SELECT 1 FROM n i WHERE i.severity <> 'GREEN' AND i.document = n.document AND i.title = n.title)""",
    "report_assessment": f"""WITH {DOCS}, x AS (SELECT parent, count(*) AS documents, count(*) FILTER (WHERE NOT (status = 'COMPLETED' AND rules_checked > 0)) AS open, max(score) AS top,
      count(*) FILTER (WHERE status = 'COMPLETED' AND rules_checked > 0 AND score IS NULL) AS unscored, sum(critical) AS critical, sum(warning) AS warning, sum(unknown) AS unknown, CAST(sum(rules_checked) AS BIGINT) AS rules_checked FROM docs GROUP BY parent)
      SELECT parent, documents, open, CASE WHEN open = 0 AND unscored = 0 THEN top END AS score, CASE WHEN open > 0 THEN 'UNKNOWN' ELSE {_LIGHT} END AS light, rules_checked FROM x""",
    "annotated_allowed": f"WITH {DOCS} SELECT parent, count(*) = 1 AND sum(unknown) = 0 AS allowed FROM docs GROUP BY parent",
    "result_fingerprint": f"""WITH {FINDINGS} SELECT document, sha256(CAST(to_json(list({{'line': line, 'rule': rule, 'severity': severity, 'review_status': review_status}}
      ORDER BY line, rule NULLS FIRST, severity, review_status)) AS VARCHAR)) AS fingerprint FROM v GROUP BY document""",
    "name_projections": r"""SELECT c_custkey, 'CX' AS initials, c_name || '.PDF' AS base, 'n' || c_custkey || '.PDF' AS renamed, regexp_replace(c_name, '[^\w]+', '_', 'g') AS slug,
      lower(regexp_extract(c_name, '^\D+')) || lpad(regexp_replace(regexp_extract(c_name, '\d+'), '^0+', ''), 20, '0') AS sort_key FROM customer""",
    "cascade_delete": f"""WITH {FINDINGS} SELECT document, line FROM f WHERE document NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN
      (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)))""",
}
