"""Reports of whole analyses against slow versions: one JSON, its fragments in order, CSV files, files that are written."""

from __future__ import annotations

import csv
import io
import json
import random
from pathlib import Path

import pytest
from pyarrow import parquet
from pyspark.sql import functions as F

from lexweave.operators import exports, findings, reports
from lexweave.plans import registry
from tests.oracle import connect, same

ANALYSES = "analysis long, mode string, title string, original_filename string, generated_at string, author string, company string, traffic_light string, risk_score long, rules_checked long"
DOCUMENTS = "analysis long, document long, file_name string, relative_path string, status string, total_pages int, law_type string, risk_score long, traffic_light string"
FINDINGS = "document long, place long, number long, severity string, category string, title string, short_description string, page_number long, clause string, exact_quote string, comment string, counter_proposal string, legal_reference string, review_status string, reviewer_comment string, quote_verified boolean, source string, highlights array<struct<page:long>>"


def tables(seed=2):
    rng = random.Random(seed)
    analyses, documents, findings = [], [], []
    for a, n in enumerate((0, 1, 1, 2, 5)):
        name = rng.choice(("up.zip", "up.pdf", "UP.ZIP"))
        analyses.append((a, rng.choice(("brief", "detailed", "odd")), f't"{a}"\n', name, "now", rng.choice(("A; B", None, "")), None, "RED", rng.choice((None, 7)), a))
        for k in range(n):
            d = 10 * a + k
            documents.append((a, d, rng.choice((name, f"d{d}.pdf")), rng.choice((None, "", f"in/{9 - k}", f"=in/{k}")), "COMPLETED", 3, None, rng.choice((None, 50)), "GREEN"))
            for i in sorted(rng.sample(range(20), rng.randrange(0, 6))):
                severity = rng.choice(("RED", "GREEN", "ODD"))
                text = lambda: rng.choice((None, "", "=1+1", "two\nlines", 'a "quote"; x', "ёжик", "\t"))
                findings.append((d, i, None if severity == "GREEN" else i + 1, severity, text(), text(), text(), rng.choice((None, 0, 4)), text(), text(), text(), text(), text(), rng.choice(("NEW", "RESOLVED", "ODD")), None, rng.choice((True, False)), "S", [(1,)] if i % 2 else []))
    findings.append((999, 0, 1, "RED", *[None] * 14))  # of no document
    return analyses, documents, findings


def named(schema, rows):
    names = [f.split()[0] for f in schema.split(", ")]
    return [dict(zip(names, r, strict=True)) for r in rows]


def slow_reports(analyses, documents, findings):
    out = {}
    findings = [f | {"highlights": f["highlights"] and [{"page": p} for (p,) in f["highlights"]]} for f in named(FINDINGS, findings)]
    for a in named(ANALYSES, analyses):
        docs = sorted((d for d in named(DOCUMENTS, documents) if d["analysis"] == a["analysis"]), key=lambda d: (d["relative_path"] or "", d["document"]))
        if docs:
            shown = lambda d: sorted((f for f in findings if f["document"] == d["document"] and (a["mode"] == "detailed" or f["severity"] != "GREEN")), key=lambda f: f["place"])
            report = {"mode": a["mode"], "analysis_id": str(a["analysis"])} | {c: a[c] for c in exports.HEAD[1:]}
            report["documents"] = [{"id": str(d["document"])} | {c: d[c] for c in exports.DOCUMENT} | {"findings": [{c: f[c] for c in exports.FINDING} for f in shown(d)]} for d in docs]
            if len(docs) == 1:
                report["target_document"] = {"id": str(docs[0]["document"]), "file_name": docs[0]["file_name"], "relative_path": docs[0]["relative_path"]}
            out[a["analysis"]] = report
    return out


def frames(spark, parts):
    return [spark.createDataFrame(rows, schema).repartition(2) for rows, schema in zip(parts, (ANALYSES, DOCUMENTS, FINDINGS), strict=True)]


def lines_of(folder):
    """The lines of each analysis in the order of the files."""
    out = {}
    for file in sorted(Path(folder).glob("analysis=*/part-*.txt")):
        out.setdefault(int(file.parent.name.split("=")[1]), []).append(file.read_bytes().decode())
    return {k: "".join(v) for k, v in out.items()}


@pytest.mark.parametrize("seed", [2, 5])
def test_json_is_the_same_as_one_value_and_in_fragments(spark, tmp_path, seed):
    parts = tables(seed)
    wanted = slow_reports(*parts)
    nested = {r.analysis: r.json for r in exports.nested_reports(*frames(spark, parts)).collect()}
    assert {k: json.loads(v) for k, v in nested.items()} == wanted and len(wanted) == 4
    assert all(list(json.loads(nested[k])) == list(wanted[k]) for k in wanted)
    exports.write_reports(exports.json_fragments(*frames(spark, parts)), str(tmp_path / "json"))
    written = lines_of(tmp_path / "json")
    assert {k: v.replace("\n", "") for k, v in written.items()} == nested


def test_csv_files_can_be_read_back(spark, tmp_path):
    parts = tables()
    exports.write_reports(exports.csv_lines(*frames(spark, parts)), str(tmp_path / "csv"), "\r\n")
    written, wanted = lines_of(tmp_path / "csv"), slow_reports(*parts)
    assert written.keys() == wanted.keys()
    guard = lambda v: "" if v is None else "'" + v if isinstance(v, str) and (v.lstrip().startswith("=") or v[:1] in "\t\r\n" and v) else str(v)
    for a, report in wanted.items():
        text, docs, upload = written[a], report["documents"], report["original_filename"]
        assert text.startswith("﻿")
        found = list(csv.reader(io.StringIO(text[1:], newline=""), delimiter=";"))
        zipped = upload.lower().endswith(".zip")
        if len(docs) == 1:
            head = [[exports.ONE_FILE, guard(docs[0]["relative_path"] or docs[0]["file_name"])]] + ([[reports.SOURCE_ARCHIVE, upload]] if zipped or docs[0]["file_name"] != upload else [])
        else:
            head = [[reports.SOURCE_ARCHIVE, upload], [exports.SEVERAL, str(len(docs))]]
        head += [[exports.MODE, exports.MODES.get(report["mode"], report["mode"])], [exports.AUTHOR, report["author"] or "—"], [exports.COMPANY, "—"], [exports.SCORE, guard(report["risk_score"])], [exports.RULES, str(report["rules_checked"])], [], list(exports.TITLES)]
        rows = [[guard(d["relative_path"] or d["file_name"]), guard(f["number"]), exports.LEVELS.get(f["severity"], f["severity"]), *[guard(f[c]) for c in ("title", "short_description", "clause")], guard(f["page_number"] or None), *[guard(f[c]) for c in ("exact_quote", "counter_proposal", "legal_reference")], exports.REVIEWS.get(f["review_status"], f["review_status"])] for d in docs for f in d["findings"]]
        assert found == head + rows


def test_reports_of_nothing(spark):
    empty = frames(spark, ([], [], []))
    assert exports.nested_reports(*empty).count() == exports.json_fragments(*empty).count() == exports.csv_lines(*empty).count() == 0


def test_appendix_lists_each_used_rule_once(spark):
    documents = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "analysis long, document long")
    findings = spark.createDataFrame([(10, 5), (11, 5), (11, None), (20, 6), (20, 7), (99, 5)], "document long, rule long")
    rules = spark.createDataFrame([(5, 1, "A", "c", "RED", ""), (6, 2, "B", None, "LOW", None), (8, 3, "C", "c", "RED", "x")], "rule long, sort_order long, title string, category string, severity string, reference string")
    found = exports.rules_appendix(documents, findings, rules).orderBy("analysis", "sort_order").collect()
    assert [tuple(r) for r in found] == [(1, 1, 5, "A", "c", "RED", "—"), (2, 2, 6, "B", None, "LOW", "—")]
    assert exports.rules_appendix(documents.where(F.lit(False)), findings, rules).count() == 0


def odd_tables(spark, folder, seed):
    """Documents without findings, customers or rules, customers without documents, equal lines, parts that no table has."""
    rng = random.Random(seed)
    lines = [(o := rng.randrange(40), rng.randrange(12), rng.randrange(25), rng.choice((1, 1, 2, 3)), float(rng.choice((1, 3, 7, 45))), rng.choice((0.0, 0.07, 0.09)), rng.choice((0.0, 0.06)), rng.choice("RAN")) for _ in range(150)]
    lines += [(39, 3, 7 * k, 1, 9.0, 0.0, 0.0, "N") for k in range(1, 4)]  # dismissed ones alone
    made = {
        "lineitem": (sorted(set(lines)), "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string"),
        "part": ([(k, f"part {k % 3}", None if k == 4 else f"Brand#{k}", k) for k in range(1, 11)], "p_partkey long, p_name string, p_brand string, p_size int"),
        "orders": ([(k, rng.randrange(14), rng.choice("FOP")) for k in (*range(46), 97, 194)], "o_orderkey long, o_custkey long, o_orderstatus string"),
        "customer": ([(k, f"C{k}", "S") for k in range(1, 18)], "c_custkey long, c_name string, c_mktsegment string"),
    }
    for name, (rows, schema) in made.items():
        parquet.write_table(spark.createDataFrame(rows, schema).toArrow(), f"{folder}/{name}.parquet")


@pytest.mark.parametrize("seed", [4, 6])
def test_reports_of_odd_tables_are_as_by_sql(spark, tmp_path, seed):
    odd_tables(spark, tmp_path, seed)
    same(registry.QUERIES["json_reports"](spark, str(tmp_path)), connect(str(tmp_path)), registry.ORACLE_SQL["json_reports"])


def test_reports_read_and_shuffle_findings_once(spark, tmp_path):
    odd_tables(spark, tmp_path, 4)
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.QUERIES["json_reports"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    # by rule, by document and by analysis, with what they are joined to
    assert plan.count("FileScan parquet [l_") == 1
    assert plan.count("Exchange hashpartitioning") <= 6


def test_gathered_findings_are_those_numbered_and_counted(spark):
    rng = random.Random(3)
    made = [(rng.randrange(8), rng.randrange(4), rng.choice((None, *range(6))), rng.choice((*findings.SEVERITIES, "ODD")), rng.choice(("NEW", "DISMISSED", "RESOLVED")), rng.choice((None, 5, 10**6))) for _ in range(120)]
    made.append((9, 1, 2, "RED", "DISMISSED", None))
    found = spark.createDataFrame(sorted(set(made), key=str), "document long, line long, rule long, severity string, review_status string, page long")
    rules = spark.createDataFrame([(k, k != 3, -k if k else None, f"t{k}", "c") for k in range(5)], "rule long, is_active boolean, sort_order long, title string, category string")
    seen = findings.visible(found, rules)
    got = findings.gathered(findings.visible_named(found, rules), "line", "rule", "page", "title").collect()
    counted = {r.document: r for r in findings.severity_counts(seen, "document").collect()}
    assert {r.document: [r[c] for c in findings.COUNTS] for r in got} == {k: [r[c] for c in findings.COUNTS] for k, r in counted.items()}
    numbered = findings.renumbered(seen, rules).join(rules.select("rule", "title"), "rule", "left").where("review_status <> 'DISMISSED'").orderBy("document", "sort_index").collect()
    fields = ("sort_index", "severity", "review_status", "line", "rule", "page", "title")
    assert [(r.document, *[f[c] for c in fields]) for r in sorted(got, key=lambda r: r.document) for f in r.findings] == [(r.document, *[r[c] for c in fields]) for r in numbered]
    assert {r.document: set(r.rules) for r in got} == {k: {r.rule for r in seen.collect() if r.document == k and r.rule is not None} for k in counted}
    assert [r.findings for r in got if r.document == 9] == [[]]
