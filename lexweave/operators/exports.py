"""Whole reports of analyses: nested JSON, CSV with a preamble, the appendix of rules.

A report is a tree: an analysis, its documents by path, their findings by place. ``nested_reports`` builds it as one value,
for analyses of ordinary size. ``json_fragments`` and ``csv_lines`` make a row for each line of the file instead, with
columns that order them; nothing is gathered, so that one analysis may hold most of all findings. Written in order, the
fragments are the same JSON.

``analyses`` have analysis and the columns of ``HEAD``, ``documents`` analysis, document and the columns of ``DOCUMENT``,
``findings`` document, place and the columns of ``FINDING``. Analyses without documents have no report.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.operators.reports import guarded_cell, source_label

# Names of modes, fields of reports in order, titles and labels of CSV reports.
MODES = {"brief": "Краткий", "detailed": "Подробный", "protocol": "Протокол разногласий"}
HEAD = ("mode", "title", "original_filename", "generated_at", "author", "company", "traffic_light", "risk_score", "rules_checked")
DOCUMENT = ("file_name", "relative_path", "status", "total_pages", "law_type", "risk_score", "traffic_light")
FINDING = (
    "number", "severity", "category", "title", "short_description", "page_number", "clause", "exact_quote", "comment",
    "counter_proposal", "legal_reference", "review_status", "reviewer_comment", "quote_verified", "source", "highlights",
)
TITLES = ("Документ", "№", "Уровень", "Замечание", "Описание", "Пункт", "Страница", "Цитата", "Рекомендация", "Норма", "Статус")
LEVELS = {"RED": "Критические замечания", "YELLOW": "Требуют внимания", "LOW": "Низкий риск", "UNKNOWN": "Недостаточно данных", "GREEN": "Без замечаний"}
REVIEWS = {"NEW": "Не просмотрено", "CONFIRMED": "Принято", "RESOLVED": "Принято", "DISMISSED": "Отклонено"}
ONE_FILE, SEVERAL, MODE, AUTHOR, COMPANY, SCORE, RULES = "Проверенный файл", "Документов в отчёте", "Режим", "Подготовил", "Компания", "Индекс риска", "Проверено правил"
#: What orders the rows of a report: block 0 is its head, 1 its documents, 2 its end; part 0 opens a document, 2 ends it.
ORDER = ("analysis", "block", "path", "document", "part", "place")
_BOM = "\ufeff"


def _json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def _opened(json: Column, name: str) -> Column:
    """An object of which a list is still to come."""
    return F.concat(F.left(json, F.length(json) - 1), F.lit(f',"{name}":['))


def _reported(analyses: DataFrame, documents: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Analyses with the number of their documents and the first one, documents, and the findings that the mode shows."""
    placed = documents.select("analysis", "document", F.coalesce("relative_path", F.lit("")).alias("path"), *DOCUMENT)
    counts = placed.groupBy("analysis").agg(F.count("*").alias("n"), F.min(F.struct("path", "document", "file_name", "relative_path")).alias("first"))
    heads = analyses.join(counts, "analysis")
    of = placed.select("document", "analysis", "path", "file_name", "relative_path").join(analyses.select("analysis", "mode"), "analysis")
    shown = findings.join(of, "document").where("mode = 'detailed' OR severity <> 'GREEN'").drop("mode")
    return heads, placed.join(heads.select("analysis", "first"), "analysis"), shown


def _head_fields() -> list[Column]:
    return [F.col("mode"), F.col("analysis").cast("string").alias("analysis_id"), *[F.col(c) for c in HEAD[1:]]]


def _document_fields(of: Callable[[str], Column] = F.col) -> list[Column]:
    return [of("document").cast("string").alias("id"), *[of(c).alias(c) for c in DOCUMENT]]


def _target() -> Column:
    """The only document of an analysis that has one."""
    of = F.col("first")
    return F.struct(of["document"].cast("string").alias("id"), of["file_name"].alias("file_name"), of["relative_path"].alias("relative_path"))


def nested_reports(analyses: DataFrame, documents: DataFrame, findings: DataFrame) -> DataFrame:
    """(analysis, n_documents, json): each report as one JSON object; fields without a value are null."""
    in_order = F.array_sort(F.collect_list(F.struct("place", *FINDING)))
    items = findings.groupBy("document").agg(in_order.alias("findings"))
    whole = documents.join(items, "document", "left").groupBy("analysis").agg(F.collect_list(whole_document()).alias("reported"))
    return whole_reports(analyses.join(whole, "analysis"), lambda f: [f[c].alias(c) for c in FINDING])


def whole_document() -> Column:
    """A document for ``whole_reports``, of the columns document, those of ``DOCUMENT`` and findings."""
    return F.struct(F.coalesce("relative_path", F.lit("")).alias("path"), "document", *DOCUMENT, "findings")


def whole_reports(analyses: DataFrame, fields: Callable[[Column], list[Column]]) -> DataFrame:
    """``nested_reports`` of ``analyses`` that have their documents in ``reported``, an array of ``whole_document``.

    The findings of a document are in order, null for none. They have severity and whatever ``fields`` makes the columns
    of ``FINDING`` of: that is done here, after all shuffles, as the texts are much longer than what they are made of.
    """
    shown = lambda f: (F.col("mode") == "detailed") | (f["severity"] != "GREEN")
    texts = lambda d: F.coalesce(F.transform(F.filter(d["findings"], shown), lambda f: F.struct(*fields(f))), F.array())
    item = lambda d: F.struct(*_document_fields(d.getField), texts(d).alias("findings"))
    placed = analyses.withColumn("reported", F.array_sort("reported")).withColumn("first", F.element_at("reported", 1))
    rows = placed.withColumn("n", F.size("reported").cast("long")).withColumn("documents", F.transform("reported", item))
    head = [*_head_fields(), F.col("documents")]
    json = F.when(F.col("n") == 1, _json(*head, _target().alias("target_document"))).otherwise(_json(*head))
    return rows.select("analysis", F.col("n").alias("n_documents"), json.alias("json"))


def _row(block: int, part: int, text: Column, place: Column | None = None) -> list[Column]:
    inner = block == 1
    path = F.col("path") if inner else F.lit("")
    document = F.col("document") if inner else F.col("first.document")
    return [F.col("analysis"), F.lit(block).alias("block"), path.alias("path"), document.alias("document"), F.lit(part).alias("part"), (F.lit(0) if place is None else place).cast("long").alias("place"), text.alias("text")]


def json_fragments(analyses: DataFrame, documents: DataFrame, findings: DataFrame) -> DataFrame:
    """The columns of ``ORDER`` and text: ``nested_reports`` in fragments; a comma begins all but the first of a list."""
    heads, placed, shown = _reported(analyses, documents, findings)
    comma = lambda is_first, text: F.concat(F.when(is_first, "").otherwise(","), text)
    firsts = shown.groupBy("document").agg(F.min("place").alias("least"))
    opened = _opened(_json(*_document_fields()), "findings")
    item = _json(*[F.col(c) for c in FINDING])
    end = F.when(F.col("n") == 1, F.concat(F.lit('],"target_document":'), _json(*[_target()[c].alias(c) for c in ("id", "file_name", "relative_path")]), F.lit("}"))).otherwise("]}")
    rows = [
        heads.select(*_row(0, 0, _opened(_json(*_head_fields()), "documents"))),
        placed.select(*_row(1, 0, comma(F.col("document") == F.col("first.document"), opened))),
        shown.join(firsts, "document").select(*_row(1, 1, comma(F.col("place") == F.col("least"), item), F.col("place"))),
        placed.select(*_row(1, 2, F.lit("]}"))),
        heads.select(*_row(2, 0, end)),
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def _cells(*cells: Column) -> Column:
    """A line of a CSV file: all cells quoted, and guarded if they are texts; an empty cell without a value."""
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(guarded_cell(c), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in cells]
    return F.concat_ws(";", *quoted)


def csv_lines(analyses: DataFrame, documents: DataFrame, findings: DataFrame) -> DataFrame:
    """The columns of ``ORDER`` and text: a byte order mark and a preamble, an empty line, titles, a line a finding."""
    heads, _, shown = _reported(analyses, documents, findings)
    text = lambda c: F.col(c).cast("string")
    filled = lambda c: F.coalesce(F.nullif(text(c), F.lit("")), F.lit("—"))
    labelled = lambda c, names: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), F.col(c)), F.col(c))
    pair = lambda label, value: _cells(F.lit(label) if isinstance(label, str) else label, value)
    shown_name = lambda of: F.coalesce(F.nullif(of["relative_path"], F.lit("")), of["file_name"])
    upload, one = F.col("original_filename"), F.col("n") == 1
    packed = source_label(upload, F.lit(1))
    other = (packed == source_label(F.lit("x.zip"), F.lit(1))) | (F.col("first.file_name") != upload)
    lines = F.filter(
        F.array(
            F.when(one, pair(ONE_FILE, shown_name(F.col("first")))).otherwise(pair(source_label(upload, F.col("n")), upload)),
            F.when(one & other, pair(source_label(F.lit("x.zip"), F.lit(1)), upload)).when(~one, pair(SEVERAL, text("n"))),
            pair(MODE, labelled("mode", MODES)), pair(AUTHOR, filled("author")), pair(COMPANY, filled("company")), pair(SCORE, text("risk_score")), pair(RULES, text("rules_checked")),
            F.lit(""),
            _cells(*[F.lit(t) for t in TITLES]),
        ),
        lambda line: line.isNotNull(),
    )
    preamble = heads.select("analysis", "first", F.posexplode(lines).alias("place", "line"))
    marked = F.concat(F.when(F.col("place") == 0, _BOM).otherwise(""), "line")
    number = F.when(F.col("number") > 0, text("number"))
    page = F.when(F.col("page_number") != 0, text("page_number"))
    cells = [F.coalesce(F.nullif("relative_path", F.lit("")), "file_name"), number, labelled("severity", LEVELS), text("title"), text("short_description"), text("clause"), page, text("exact_quote"), text("counter_proposal"), text("legal_reference"), labelled("review_status", REVIEWS)]
    return preamble.select(*_row(0, 0, marked, F.col("place"))).unionByName(shown.select(*_row(1, 1, _cells(*cells), F.col("place"))))


def write_reports(rows: DataFrame, path: str, line_end: str = "\n") -> None:
    """A folder for each analysis with its rows as lines of text, in the order of the files' names.

    Rows are dealt by ranges of the whole order, so that tasks are even however large an analysis is.
    """
    dealt = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    dealt.select("analysis", "text").write.partitionBy("analysis").option("lineSep", line_end).mode("overwrite").text(path)


def rules_appendix(documents: DataFrame, findings: DataFrame, rules: DataFrame) -> DataFrame:
    """(analysis, sort_order, rule, title, category, level, reference): the rules that an analysis used, to be shown by
    sort_order.

    ``findings`` are all that were checked, dismissed ones too; ``rules`` have rule, sort_order, title, category,
    severity and reference.
    """
    used = findings.where("rule IS NOT NULL").select("document", "rule").join(documents.select("document", "analysis"), "document").select("analysis", "rule").distinct()
    reference = F.coalesce(F.nullif("reference", F.lit("")), F.lit("—"))
    return used.join(rules, "rule").select("analysis", "sort_order", "rule", "title", "category", F.col("severity").alias("level"), reference.alias("reference"))
