"""What comes in, over the driver's tables: uploads with archives, answers of models, marked terms, owned files."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators import answers, evaluate, reports, search
from lexweave.plans import rollups
from lexweave.plans.rollups import table
from lexweave.plans.session import shared_dir
from lexweave.sources import uploads
from lexweave.streaming import feeds

#: Documents that go into one archive.
PACKED = 8


def _zipped(members: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def _archive(docs: pd.DataFrame) -> pd.DataFrame:
    """An archive of documents: texts and other files, some in an archive inside, some with names that do not count."""
    k = int(docs["doc_id"].iloc[0]) // PACKED
    members, inner = [], []
    for i, text in zip(docs["doc_id"], docs["text"], strict=True):
        data = (text or "").encode()
        name = {0: f"in/Doc{i}.TXT", 1: f"doc{i}.exe", 2: f"a:b?{i}.pdf" if i % 16 > 8 else f"x/b?{i}.pdf", 3: f"../up{i}.pdf", 4: f"~${i}.docx", 5: f"__MACOSX/{i}.pdf"}.get(i % 8, f"n{i}.txt")
        (inner if i % 8 == 6 else members).append((name, data))
    if inner:
        members.append((f"inner{k}.zip", _zipped([*inner, ("deep.zip", _zipped([("d.txt", b"deep"), ("deeper.zip", _zipped([("e.zip", b"never"), ("e.txt", b"never")]))]))])))
    content = _zipped(members)
    path = f"up{k}.zip" if k % 7 else f"up{k}.pdf"
    if k % 11 == 3:
        content = b"PK no archive"
    elif k % 11 == 4:
        content = b"other bytes"
    elif k % 11 == 5:
        content = b""
    return pd.DataFrame({"path": [path], "length": [len(content)], "content": [content]})


def upload_files(spark: SparkSession, d: str) -> DataFrame:
    """(path, length, content): eight documents to an archive; some uploads are broken, empty or wrongly named."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs.groupBy(F.floor(F.col("doc_id") / PACKED)).applyInPandas(_archive, "path string, length long, content binary")


def uploaded_documents(spark: SparkSession, d: str) -> DataFrame:
    found = uploads.uploaded_documents(upload_files(spark, d))
    return found.select("path", "member", F.when(~F.endswith("path", F.lit(".pdf")), F.col("size")).alias("size"), "supported", "error", F.sha2("content", 256).alias("digest"))


def model_answers(spark: SparkSession, d: str) -> DataFrame:
    """The first line of each document as a quote in an answer; its number says what is wrong with the answer."""
    k = F.col("doc_id")
    line = F.substring_index("text", "\n", 1)
    cited = [F.lit("F1").alias("fragment"), line.alias("quote")]

    def issue(fragment: str = "F1", summary: str = "s", confidence: float = 0.5) -> Column:
        return F.struct(F.lit(fragment).alias("fragment"), cited[1], F.lit("RED").alias("severity"), F.lit(summary).alias("summary"), F.lit("c").alias("comment"), F.lit("r").alias("recommendation"), F.lit(confidence).alias("confidence"))

    none = F.array()
    evidence = F.array(F.struct(*cited))
    told = lambda verdict, issues, found, **more: F.to_json(F.struct(F.lit(verdict).alias("verdict"), issues.alias("issues"), found.alias("evidence"), *[v.alias(n) for n, v in ({"explanation": F.lit("e")} | more).items() if v is not None]))
    forms = [
        told("RISK", F.array(issue()), none),
        F.concat(F.lit("Here: ```json\n"), told("OK", none, evidence), F.lit("\n``` done")),
        F.concat(F.lit("So "), told("NOT_FOUND", none, none), F.lit(" it is")),
        told("UNKNOWN", none, none),
        F.lit('{"verdict": "UNKNOWN", "issues": [], "evidence": [], "explanation": "e", "verdict": "OK"}'),
        F.lit('{"verdict": "UNKNOWN", "issues": [], "evidence": [], "explanation": NaN}'),
        told("UNKNOWN", none, none, explanation=None),
        told("UNKNOWN", none, none, extra=F.lit(1)),
        told("RISK", none, none),
        told("OK", none, none),
        told("RISK", F.array(issue(), issue(), issue(), issue()), none),
        told("RISK", F.array(issue(confidence=1.5)), none),
        told("RISK", F.array(issue(summary=" ")), none),
        told("RISK", F.array(issue(fragment="F0")), none),
        F.lit("I can't say."),
        F.lit("[1]"),
        told("MAYBE", none, none),
        told("UNKNOWN", none, evidence),
        told("UNKNOWN", none, none, explanation=line),
    ]
    text = F.get(F.array(*forms), (k % len(forms)).cast("int"))
    rows = table(spark, d, "documents").select("doc_id", text.alias("text"))
    found = answers.typed_answers(rows, "text")
    quotes = F.concat(F.transform("issues", lambda i: i["quote"]), F.transform("evidence", lambda i: i["quote"]))
    return found.select("doc_id", "verdict", F.size("issues").cast("long").alias("n_issues"), F.size("evidence").cast("long").alias("n_evidence"), F.sha2(F.array_join(quotes, "|"), 256).alias("quotes"), "refusal")


#: Sentences with markers of the fixed rules, with exceptions, and with none.
TERMS = (
    "Односторонний отказ вступает в силу через 3 (три) рабочих дня", "Поставка товара в течение 5 дней", "Поставка товара в течение 15 дней", "Устранить в течение 24 (двадцати четырех) часов",
    "Гарантия покрывает 100 % требования", "Убытки взыскиваются сверх неустойки", "Замена на эквивалент не допускается", "Cisco или эквивалент", "Штраф в размере 10 (десяти) процентов",
    "Штраф в размере 3 процентов", "Исключительно по контрактам 44-ФЗ", "Исключительные права переходят к заказчику", "Привлечение субподрядчиков из СМП", "Реестр российской продукции",
    "Размер обеспечения заявки", "Обеспечение исполнения 30 % цены", "Указан товарный знак", "Обычное условие без отметок", "Незамедлительно устранить", "Безакцептное списание",
)


def marked_terms(spark: SparkSession, d: str) -> DataFrame:
    """A term after the first line of each document, looked at with the fixed markers, exceptions and guards."""
    term = F.get(F.array(*[F.lit(t) for t in TERMS]), (F.col("doc_id") % len(TERMS)).cast("int"))
    text = F.concat(F.substring_index("text", "\n", 1), F.lit("\n"), term)
    ids = lambda found: F.array_join(found, ",")
    return table(spark, d, "documents").select("doc_id", ids(evaluate.marked_rules(text)).alias("marked"), ids(evaluate.allowed_rules(text)).alias("allowed"))


def owned_documents(spark: SparkSession, d: str) -> DataFrame:
    """Orders of the customers that one user has; customers of nation 0 are no one's and so are everyone's."""
    owner = F.when(F.col("c_nationkey") > 0, F.col("c_nationkey"))
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), owner.alias("owner"))
    return search.owned_through(table(spark, d, "orders").select("o_custkey", "o_orderkey"), customers, "o_custkey", "owner", 7)


def files_search(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("parent"), F.col("c_name").alias("title"), F.concat("c_mktsegment", F.lit(".pdf")).alias("file"))
    files = rollups.rollup_customer(spark, d).select("parent", "stage").join(names, "parent")
    return search.uploads_matching(files, "ing.PDF", "completed", ["title", "file"], "stage")


def finding_labels(spark: SparkSession, d: str) -> DataFrame:
    """Where findings stand, in words, and the progress of documents of as many pages as their page says."""
    line = F.col("line")
    clause = F.when(line % 3 == 0, F.concat(line, F.lit(".1"))).when(line % 3 == 1, "раздел")
    rows = rollups.visible(spark, d)
    return rows.select("document", "line", reports.location(clause, F.col("page")).alias("label"), search.progress(line, F.coalesce("page", F.lit(0))).alias("progress"))


def heuristic_notes(spark: SparkSession, d: str) -> DataFrame:
    """Which findings of a document come from keywords: all of documents with an even number, else every second line."""
    source = F.when((F.col("document") % 2 == 0) | (F.col("line") % 2 == 0), "HEURISTIC").otherwise("LLM")
    rows = rollups.visible(spark, d).select("document", F.col("line").alias("number"), source.alias("source"))
    return reports.heuristic_note(rows, "document").select("document", "note", F.array_join("numbers", ",").alias("numbers"))


def _snapshots(events: DataFrame) -> DataFrame:
    """Events as the states of 4 files in each of 20 accounts."""
    k, kind = F.col("event_id"), F.col("event_type")
    phase = F.when(kind == "purchase", "ready").when(kind == "error", "failed").otherwise("processing")
    error = F.when(kind == "error", F.concat(F.lit("e"), k % 2)).when((kind == "purchase") & (k % 7 == 0), "late")
    return events.select((F.col("user_id") % 20).alias("account"), (k % 4).alias("file"), F.col("ts").cast("timestamp").alias("ts"), "event_id", phase.alias("phase"), error.alias("error"), F.floor(F.col("value") / 50).alias("critical"))


def _notice(found: DataFrame, time: str, event: str) -> DataFrame:
    names = F.element_at(F.array(*[F.lit(k) for k in feeds.KINDS]), F.col("kind") + 1)
    return found.select("account", "file", F.col(time).cast("timestamp_ntz").alias("ts"), F.col(event).alias("event_id"), names.alias("kind"), "place")


def notices_kept(spark: SparkSession, d: str) -> DataFrame:
    found = feeds.notices(_snapshots(table(spark, d, "events")), ["account", "file"], ["ts", "event_id"])
    return _notice(feeds.last_notices(found, "account", "file", ["ts", "event_id", "kind"]), "ts", "event_id")


def notices_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same by a streaming query that drains the table and stops."""
    source, out = f"{d}/events.parquet", f"{shared_dir(spark)}/lexweave-stream-{uuid.uuid4().hex}"
    events = spark.readStream.schema(spark.read.parquet(source).schema).parquet(f"{source}*")
    rings = feeds.notice_rings(_snapshots(events), "account", "file", "ts", "event_id")
    query = rings.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return _notice(feeds.last_of_rings(spark.read.schema(rings.schema).parquet(f"{out}/rows"), "account", "file"), "at", "event")


QUERIES = {f.__name__: f for f in (notices_kept, notices_stream, uploaded_documents, model_answers, marked_terms, owned_documents, files_search, finding_labels, heuristic_notes)}

_WORD = r"[\p{L}\p{N}_]"


def _pattern(pattern: str) -> str:
    """The same in a dialect that knows Latin words only and can't look ahead; what the look-ahead bars can't follow."""
    return "(?i)" + pattern.replace(r"\w", _WORD).replace(r"(?!\d)", "").replace(r"\b", rf"(?:^|$|[^{_WORD[1:]})")


def _marked() -> str:
    has = lambda p: f"regexp_matches(t, '{_pattern(p)}')"
    marked = [f"CASE WHEN {has(evaluate.MARKERS[r])}{f' AND NOT {has(evaluate.EXCEPTIONS[r])}' if r in evaluate.EXCEPTIONS else ''} THEN '{r}' END" for r in sorted(evaluate.MARKERS)]
    allowed = [f"CASE WHEN {has(evaluate.GUARDS[r])} THEN '{r}' END" for r in sorted(evaluate.GUARDS)]
    terms = ", ".join(f"'{t}'" for t in TERMS)
    return f"WITH x AS (SELECT doc_id, string_split(text, chr(10))[1] || chr(10) || [{terms}][doc_id % {len(TERMS)} + 1] AS t FROM documents) SELECT doc_id, CASE WHEN t IS NOT NULL THEN concat_ws(',', {', '.join(marked)}) END AS marked, CASE WHEN t IS NOT NULL THEN concat_ws(',', {', '.join(allowed)}) END AS allowed FROM x"


_NOTICES = """WITH e AS (SELECT user_id % 20 AS account, event_id % 4 AS file, ts, event_id, CASE event_type WHEN 'purchase' THEN 'ready' WHEN 'error' THEN 'failed' ELSE 'processing' END AS phase,
        CASE WHEN event_type = 'error' THEN 'e' || event_id % 2 WHEN event_type = 'purchase' AND event_id % 7 = 0 THEN 'late' ELSE '' END AS error, floor(value / 50) AS critical FROM events),
      b AS (SELECT *, lag(phase) OVER w AS before, lag(error) OVER w AS old FROM e WINDOW w AS (PARTITION BY account, file ORDER BY ts, event_id)),
      n AS (SELECT *, unnest(list_filter([CASE WHEN phase <> 'processing' AND error <> '' AND (before = 'processing' OR error <> old) THEN 1 END, CASE WHEN before = 'processing' AND phase = 'ready' AND error = '' THEN 2 END,
        CASE WHEN before = 'processing' AND phase = 'ready' AND critical > 0 THEN 3 END], lambda k: k IS NOT NULL)) AS k FROM b WHERE before IS NOT NULL)
      SELECT account, file, ts, event_id, ['error', 'completed', 'critical'][k] AS kind, row_number() OVER (PARTITION BY account ORDER BY ts DESC, event_id DESC, k DESC) AS place FROM n QUALIFY place <= 30"""
ORACLE_SQL = {
    "notices_kept": _NOTICES,
    "notices_stream": _NOTICES,
    "uploaded_documents": rf"""WITH g AS (SELECT doc_id // {PACKED} AS k, count(*) FILTER (WHERE doc_id % 8 = 6) > 0 AS nested, count(*) FILTER (WHERE doc_id % 8 NOT IN (3, 4, 5, 6) AND NOT (doc_id % 8 = 2 AND doc_id % 16 > 8)) > 0 AS plain FROM documents GROUP BY 1),
      u AS (SELECT *, CASE WHEN k % 7 = 0 THEN CASE WHEN k % 11 = 5 THEN 'empty' ELSE 'wrong content' END WHEN k % 11 = 5 THEN 'empty' WHEN k % 11 = 4 THEN 'wrong content' WHEN k % 11 = 3 THEN 'not a ZIP' WHEN NOT nested AND NOT plain THEN 'no files' END AS error,
        'up' || k || CASE WHEN k % 7 = 0 THEN '.pdf' ELSE '.zip' END AS path FROM g),
      m AS (SELECT doc_id // {PACKED} AS k, coalesce(text, '') AS content, CASE doc_id % 8 WHEN 0 THEN 'in/Doc' || doc_id || '.TXT' WHEN 1 THEN 'doc' || doc_id || '.exe' WHEN 2 THEN 'x/b_' || doc_id || '.pdf'
          WHEN 6 THEN 'inner' || doc_id // {PACKED} || '.zip/n' || doc_id || '.txt' ELSE 'n' || doc_id || '.txt' END AS member FROM documents WHERE doc_id % 8 NOT IN (3, 4, 5) AND NOT (doc_id % 8 = 2 AND doc_id % 16 > 8)
        UNION ALL SELECT k, 'deep', 'inner' || k || '.zip/deep.zip/d.txt' FROM g WHERE nested)
      SELECT path, '' AS member, CASE WHEN k % 7 > 0 THEN CAST(0 AS BIGINT) END AS size, false AS supported, error, CAST(NULL AS VARCHAR) AS digest FROM u WHERE error IS NOT NULL
      UNION ALL SELECT path, member, strlen(content), member NOT LIKE '%.exe', NULL, sha256(content) FROM u JOIN m USING (k) WHERE error IS NULL""",
    "model_answers": """WITH a AS (SELECT doc_id, doc_id % 19 AS f, string_split(text, chr(10))[1] AS line, text IS NULL AS nothing FROM documents),
      r AS (SELECT *, CASE WHEN f IN (4) THEN 'repeated key' WHEN f = 5 THEN 'number not finite' WHEN f IN (6, 7) THEN 'fields' WHEN f IN (8, 9) THEN 'verdict and lists' WHEN f IN (10, 11, 12, 13) THEN 'issues'
        WHEN f = 14 THEN 'no JSON' WHEN f = 15 THEN 'no object' WHEN f = 16 THEN 'verdict' WHEN f = 0 AND (nothing OR length(line) > 3000) THEN 'issues' WHEN f IN (1, 17) AND (nothing OR length(line) > 3000) THEN 'evidence'
        WHEN f = 17 THEN 'verdict and lists' WHEN f = 18 AND nothing THEN 'fields' WHEN f = 18 AND (length(trim(line)) = 0 OR length(trim(line)) > 3000) THEN 'explanation' END AS refusal FROM a)
      SELECT doc_id, CASE WHEN refusal IS NULL THEN CASE f WHEN 0 THEN 'RISK' WHEN 1 THEN 'OK' WHEN 2 THEN 'NOT_FOUND' ELSE 'UNKNOWN' END END AS verdict, CASE WHEN refusal IS NULL THEN CAST(f = 0 AS BIGINT) END AS n_issues,
        CASE WHEN refusal IS NULL THEN CAST(f = 1 AS BIGINT) END AS n_evidence, CASE WHEN refusal IS NULL THEN sha256(CASE WHEN f IN (0, 1) THEN line ELSE '' END) END AS quotes, refusal FROM r""",
    "marked_terms": _marked(),
    "owned_documents": "SELECT o_custkey, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey IN (0, 7)",
    "files_search": f"WITH {rollups.FILES} SELECT parent, stage, c_name AS title, c_mktsegment || '.pdf' AS file FROM files JOIN customer ON c_custkey = parent WHERE stage = 'COMPLETED' AND (c_name ILIKE '%ing.PDF%' OR c_mktsegment || '.pdf' ILIKE '%ing.PDF%')",
    "finding_labels": f"""WITH {rollups.FINDINGS}, p AS (SELECT *, CASE WHEN line % 3 = 0 THEN 'п. ' || line || '.1' WHEN line % 3 = 1 THEN 'раздел' END AS clause FROM v)
      SELECT document, line, coalesce(nullif(concat_ws(', ', clause, 'стр. ' || page), ''), '—') AS label, CAST(10 + round_even(40 * line / greatest(coalesce(page, 0), 1), 0) AS BIGINT) AS progress FROM p""",
    "heuristic_notes": f"""WITH {rollups.FINDINGS} SELECT document, CASE WHEN count(*) FILTER (WHERE h) = 0 THEN NULL WHEN count(*) FILTER (WHERE NOT h) = 0 THEN 'all' ELSE 'some' END AS note,
      coalesce(string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) FILTER (WHERE h), '') AS numbers FROM (SELECT *, document % 2 = 0 OR line % 2 = 0 AS h FROM v) GROUP BY document""",
}
