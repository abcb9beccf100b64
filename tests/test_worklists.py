"""Lists for reviewers and reports, on small tables with nulls, ties and nothing in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.operators import worklists


def test_rule_list_of_all_laws_is_exact(spark):
    rules = spark.createDataFrame([(1, True, "ALL", "a"), (2, True, "44-FZ", "a"), (3, False, "44-FZ", "b"), (4, None, None, None)], "rule int, is_active boolean, law_type string, category string")
    ids = lambda df: sorted(r.rule for r in df.collect())
    assert ids(worklists.rule_list(rules)) == [1, 2, 3, 4]
    assert ids(worklists.rule_list(rules, law="ALL")) == [1]
    assert ids(worklists.rule_list(rules, law="44-FZ")) == [1, 2, 3]
    assert ids(worklists.rule_list(rules, enabled=True, law="44-FZ", category="a")) == [1, 2]


def test_issues_without_a_number_come_last_both_ways(spark):
    rows = spark.createDataFrame([(1, 1, 3, "RED", "x"), (1, 2, None, "RED", None), (1, 3, 5, "LOW", "X"), (1, 4, 5, "GREEN", "x")], "document int, line int, number int, severity string, title string")
    order = lambda falling: [r.line for r in worklists.issue_list(rows, worklists.preferred("severity", "all"), "", ["title"], falling).orderBy("place").collect()]
    assert order(False) == [1, 3, 2] and order(True) == [3, 1, 2]
    assert worklists.issue_list(rows, worklists.preferred("severity", "LOW"), " x", ["title"]).count() == 1
    assert worklists.issue_list(rows, worklists.preferred("severity", "default"), "", ["title"]).count() == 0


def test_ocr_summary_rounds_halves_to_even(spark):
    pages = spark.createDataFrame([(1, True, 12.0), (1, True, 12.5), (1, False, 99.0), (1, None, 1.0), (2, True, None), (3, False, None)], "document int, is_ocr boolean, ocr_confidence double")
    found = {r.document: tuple(r)[1:] for r in worklists.ocr_summary(pages).collect()}
    assert found == {1: (4, True, 2, 12.2), 2: (1, True, 1, None), 3: (1, False, 0, None)}


def test_clause_labels(spark):
    rows = [("6.2", "п. 1"), (None, "Раздел › п. 3.1"), ("", "пп. 1–2"), (None, "12. Сроки"), (None, "Сроки"), (None, None), (None, "1. A › 123. B")]
    found = spark.createDataFrame(rows, "clause string, title string").select(worklists.clause_label(F.col("clause"), F.col("title"))).collect()
    assert [r[0] for r in found] == ["6.2", "3.1", "1–2", "12", None, None, None]


def test_notes_stand_at_the_first_box_that_exists(spark):
    box = [(1, 1, 2, 2)]
    rows = [(1, "RED", 5, True, [(0, box), (9, box), (3, [])]), (2, "RED", 5, False, [(2, box)]), (3, "LOW", 11, True, None), (4, "UNKNOWN", 1, True, [(1, box)]), (5, "RED", None, None, [(1, box)])]
    findings = spark.createDataFrame(rows, "line int, severity string, page int, quote_verified boolean, highlights array<struct<page: int, rects: array<struct<a: int, b: int, c: int, d: int>>>>")
    found = {r.line: (r.note_page, len(r.highlights)) for r in worklists.annotated_rows(findings, F.lit(10)).collect()}
    assert found == {1: (9, 1), 2: (5, 0), 3: (None, 0), 5: (None, 0)}


def test_findings_go_to_their_clause_then_to_their_quote(spark):
    long = "the supplier pays " * 10
    paragraphs = spark.createDataFrame([(1, 1, 0, "1.1", "One"), (1, 1, 1, "2", long), (1, 1, 2, "2", "Last, words!"), (1, 2, 0, None, None)], "document int, page int, paragraph int, clause string, text string")
    rows = [(1, 1, 10, "2", "nowhere"), (1, 1, 11, "9", "LAST words"), (1, 1, 12, None, long + "and more"), (1, 1, 13, "", ""), (1, 2, 14, None, "One"), (1, 1, 15, None, None)]
    findings = spark.createDataFrame([(*r, "RED", True) for r in rows] + [(1, 1, 16, "2", "x", "GREEN", True), (1, 1, 17, "2", "x", "RED", None)], "document int, page int, finding int, clause string, quote string, severity string, quote_verified boolean")
    found = {r.finding: r.paragraph for r in worklists.paragraph_findings(paragraphs, findings).collect()}
    assert found == {10: 1, 11: 2, 12: 1}
    assert worklists.paragraph_findings(paragraphs, findings.where("false")).count() == 0
