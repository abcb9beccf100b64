"""What reviewers and reports list: rules, issues in order, notes on pages, paragraphs with their findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.operators.findings import one_of
from lexweave.operators.quotes import normal_tokens

RISK_PLACES = {"RED": 0, "YELLOW": 1, "LOW": 2}
#: Fixed: characters of a normalised quote by which its paragraph is found.
PROBE = 60


def rule_list(rules: DataFrame, enabled: bool | None = None, law: str | None = None, category: str | None = None) -> DataFrame:
    """Rules by state, law and category. Rules for all laws suit every law; the law ``ALL`` asks for those alone."""
    if enabled is not None:
        rules = rules.where(F.col("is_active") == enabled)
    if law is not None:
        rules = rules.where(F.col("law_type").isin("ALL", law))
    return rules if category is None else rules.where(F.col("category") == category)


def by_risk(severity: str = "severity") -> Column:
    """Sort key: critical, warning, low, then the rest."""
    return one_of(severity, RISK_PLACES, 3)


def preferred(severity: str, wanted: str, defaults: tuple[str, ...] = ()) -> Column:
    """Whether a finding is a risk of the wanted severity: ``all``, ``default`` or one of them."""
    chosen = tuple(RISK_PLACES) if wanted == "all" else tuple(s for s in defaults if s in RISK_PLACES) if wanted == "default" else (wanted,)
    return F.coalesce(F.col(severity).isin(*RISK_PLACES) & F.col(severity).isin(*chosen), F.lit(False))


def issue_list(findings: DataFrame, wanted: Column, needle: str, columns: list[str], falling: bool = False) -> DataFrame:
    """Wanted findings that hold the needle in one of the columns, with their place in each document by number.

    Findings without a number come last in either direction; ties go by line. Nulls read as empty.
    """
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    number = F.col("number").desc_nulls_last() if falling else F.col("number").asc_nulls_last()
    found = findings.where(wanted & text.contains(needle.strip().lower()))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("document").orderBy(number, "line")))


def stored_summary(documents: DataFrame, findings: DataFrame, parent: str) -> DataFrame:
    """(parent, score, rules_checked) as stored: the highest score of completed documents, null if one of them has none;
    the rules of all findings, hidden ones too. A parent without findings has checked no rule."""
    done = F.col("status") == "COMPLETED"
    scored = documents.groupBy(parent).agg(F.count_if(done & F.col("score").isNull()).alias("open"), F.max(F.when(done, F.col("score"))).alias("top"))
    rules = findings.join(documents.select("document", parent), "document").groupBy(parent).agg(F.count_distinct("rule").alias("rules"))
    return scored.join(rules, parent, "left").select(parent, F.when(F.col("open") == 0, F.col("top")).alias("score"), F.coalesce("rules", F.lit(0)).cast("long").alias("rules_checked"))


def ocr_summary(pages: DataFrame) -> DataFrame:
    """(document, total_pages, is_scanned, ocr_pages, ocr_confidence): the mean over scanned pages that have one."""
    scanned = F.coalesce(F.col("is_ocr"), F.lit(False))
    return pages.groupBy("document").agg(
        F.count("*").alias("total_pages"),
        F.bool_or(scanned).alias("is_scanned"),
        F.count_if(scanned).alias("ocr_pages"),
        F.bround(F.avg(F.when(scanned, F.col("ocr_confidence"))), 1).alias("ocr_confidence"),
    )


def clause_label(clause: Column, title: Column) -> Column:
    """The clause; else the last part of a chunk's title, a list of clauses without its sign or the number of a section."""
    last = F.element_at(F.split(title, " › "), -1)
    section = F.nullif(F.regexp_extract(last, r"^(\d{1,2})\.", 1), F.lit(""))
    return F.coalesce(F.nullif(clause, F.lit("")), F.when(F.startswith(last, F.lit("п")), F.left(F.regexp_replace(last, r"^пп?\. ", ""), F.lit(255))).otherwise(section))


def brief_rows(numbered: DataFrame) -> DataFrame:
    """(document, number, severity, remark, page) of every issue; what is missing shows as a dash."""
    dash = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("—"))
    remark = F.trim(F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("summary", F.lit(""))))
    return numbered.where("severity <> 'GREEN'").select("document", "line", "number", "severity", remark.alias("remark"), dash("page").alias("page"))


def annotated_rows(findings: DataFrame, page_count: Column) -> DataFrame:
    """Findings with the page of their note and the boxes to highlight, instead of a drawn page.

    ``highlights`` is an array of (page, rects). Boxes count for verified quotes, on pages that exist, if there are any;
    the note stands at the first of them, else on the finding's own page, else in the appendix (null). Findings whose
    severity is unknown have no note.
    """
    known = F.coalesce(F.col("highlights"), F.array().cast(findings.schema["highlights"].dataType))
    exists = lambda p: p.between(1, page_count)
    blocks = F.filter(known, lambda h: F.coalesce(F.col("quote_verified"), F.lit(False)) & exists(h["page"]) & (F.size(h["rects"]) > 0))
    own = F.when(exists(F.col("page")), F.col("page"))
    noted = findings.where("severity <> 'UNKNOWN'").withColumn("highlights", blocks)
    return noted.withColumn("note_page", F.coalesce(F.get("highlights", F.lit(0))["page"], own))


def paragraph_findings(paragraphs: DataFrame, findings: DataFrame) -> DataFrame:
    """(document, page, finding, paragraph): where verified issues belong on their page.

    First the paragraph of the same clause, else the first that holds the start of the quote, both by lowest place; no
    row for a finding that has neither. Paragraphs and findings of one page meet as two arrays, so no pair of them is
    shuffled. An empty quote or clause finds nothing.
    """
    norm = lambda c: F.array_join(normal_tokens(F.coalesce(F.col(c), F.lit(""))), " ")
    lines = F.array_sort(F.collect_list(F.struct("paragraph", "clause", norm("text").alias("text"))))
    page = paragraphs.groupBy("document", "page").agg(lines.alias("paragraphs"))
    issue = findings.where("severity <> 'GREEN' AND quote_verified")
    asked = issue.select("document", "page", F.struct("finding", "clause", F.left(norm("quote"), F.lit(PROBE)).alias("probe")).alias("f"))
    found = asked.groupBy("document", "page").agg(F.collect_list("f").alias("findings")).join(page, ["document", "page"])

    def home(f: Column) -> Column:
        by_clause = F.get(F.filter("paragraphs", lambda p: (f["clause"] != "") & (p["clause"] == f["clause"])), F.lit(0))
        by_quote = F.get(F.filter("paragraphs", lambda p: (f["probe"] != "") & F.contains(p["text"], f["probe"])), F.lit(0))
        return F.struct(f["finding"].alias("finding"), F.coalesce(by_clause["paragraph"], by_quote["paragraph"]).alias("paragraph"))

    placed = found.select("document", "page", F.explode(F.transform("findings", home)).alias("x"))
    return placed.select("document", "page", "x.*").where("paragraph IS NOT NULL")
