"""Positioned words and findings from answers, against slow versions and on small tables with gaps in them."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lexweave.operators import context, drafts, located, reports, search
from lexweave.operators.quotes import STRIP

SCAN = "document long, page long, seq int, x0 double, y0 double, x1 double, y1 double, word string, block int, line int"


def scan(rng, documents=6):
    rows = []
    for d in range(documents):
        for p in range(1, rng.randrange(2, 4)):
            for seq in range(rng.randrange(0, 60)):
                word = rng.choice(["one", "two-", "Three-", "a-", "-", "...", "four", " ", "Ёж", "five,-", "un-", "x y"])
                rows.append((d, p, seq, seq + 0.04, 1.0, seq + 0.96, 2.0, word, seq // 8 % 3, seq // 3 % 2))
    return rows


def slow_words(rows):
    out = {}
    for d, p, _, x0, y0, x1, y1, word, block, line in sorted(rows, key=lambda r: r[:3]):
        page = out.setdefault((d, p), ([], {}))
        word = word.replace(" ", " ").strip()
        if word:
            page[0].append((word, page[1].setdefault((block, line), len(page[1])), (round(x0, 1), y0, round(x1, 1), y1)))
    return {k: v[0] for k, v in out.items() if v[0]}


def slow_tokens(words):
    out, count = [], {}
    for (d, p), page in sorted(words.items()):
        k = 0
        while k < len(page):
            text, line, _ = page[k]
            used = [k]
            if text.endswith("-") and len(text) > 2 and k + 1 < len(page) and page[k + 1][1] != line and page[k + 1][0][0].islower():
                text, used = text[:-1] + page[k + 1][0], [k, k + 1]
            norm = text.lower().replace("ё", "е").strip(STRIP)
            if norm:
                out.append((d, count.get(d, 0), p, norm, k == 0 or page[k - 1][1] != line, len(used)))
                count[d] = count.get(d, 0) + 1
            k += len(used)
    return out


def test_words_texts_and_tokens_equal_brute_force(spark):
    rows = scan(random.Random(5))
    words = located.laid_out_words(spark.createDataFrame(rows, SCAN).repartition(3)).cache()
    wanted = slow_words(rows)
    found = {}
    for r in words.orderBy("document", "page", "at").collect():
        found.setdefault((r.document, r.page), []).append((r.word, r.line, (r.x0, r.y0, r.x1, r.y1)))
    assert found == wanted
    texts = {(r.document, r.page): r.text for r in located.page_texts(words).collect()}
    for k, page in wanted.items():
        lines = "".join(("" if i == 0 else " " if page[i - 1][1] == page[i][1] else "\n") + page[i][0] for i in range(len(page)))
        assert texts[k] == lines
    tokens = located.positioned_tokens(words)
    got = sorted((r.document, r.position, r.page, r.norm, r.starts_line, len(r.boxes)) for r in tokens.collect())
    assert got == sorted(slow_tokens(wanted)) and any(t[5] == 2 for t in got)
    assert located.positioned_tokens(words.where("false")).count() == 0


def test_words_are_shuffled_once_and_normalised_once(spark):
    """A scan's words become tokens by one exchange, and a token's normal form is made once, not to be tested first."""
    rows = [(1, 1, k, 1.0, 2.0, 3.0, 4.0, w, 0, k // 3) for k, w in enumerate(["Ёлка–Ель", "«»", "СУП-", "plier", "a-", "b-", "c", "—", "ΌΣΟΣ", "…İ…"])]
    tokens = located.positioned_tokens(located.laid_out_words(spark.createDataFrame(rows, SCAN)))
    assert [r.norm for r in tokens.orderBy("position").collect()] == ["елка-ель", "supplier".replace("sup", "суп"), "a-", "b-", "c", "-", "όσος", "i\u0307"]
    plan = tokens._jdf.queryExecution().sparkPlan().toString()
    executed = tokens._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lower(") == 1 and executed.count("Exchange hashpartitioning") == 1


def test_quotes_stand_where_all_their_tokens_do(spark):
    text = [["Pay", "the", "sup-"], ["plier", "the", "fee."], ["The", "fee", "is", "due"]]
    rows = [(1, 1 + k // 2, 10 * k + i, 10.0 * i, 10.0 * k, 10.0 * i + 8, 10.0 * k + 8, w, 0, k) for k, line in enumerate(text) for i, w in enumerate(line)]
    words = located.laid_out_words(spark.createDataFrame(rows, SCAN))
    tokens = located.positioned_tokens(words)
    quotes = spark.createDataFrame([(1, 1, "the supplier"), (1, 2, "“The fee”"), (1, 3, "fee the"), (1, 4, "up"), (1, 5, ""), (1, 6, None), (2, 7, "fee"), (1, 8, "fee the fee is")], "document long, quote_id int, quote string")
    found = located.located_quotes(tokens, quotes)
    assert sorted((r.quote_id, r.first, r.last) for r in found.collect()) == [(1, 1, 2), (2, 3, 4), (3, 4, 5), (8, 4, 7)]
    boxes = sorted(tuple(r)[1:] for r in located.quote_boxes(found, tokens).where("quote_id IN (1, 8)").collect())
    assert boxes == [(1, 1, 0, 10.0, 0.0, 28.0, 8.0), (1, 1, 1, 0.0, 10.0, 8.0, 18.0), (8, 1, 1, 20.0, 10.0, 28.0, 18.0), (8, 2, 0, 0.0, 20.0, 28.0, 28.0)]


def test_quotes_take_their_boxes_where_they_are_found(spark):
    """The words of a scan are shuffled once for both, and a document is not repeated for each of its quotes."""
    rows = [(d, 1 + k // 4, 10 * k + i, 10.04 * i, 10.04 * k, 10.04 * i + 8.96, 10.04 * k + 8.96, w, 0, k) for d in (1, 2) for k in range(8) for i, w in enumerate(f"a{k % 3} b{k % 2} sup- plier{k} Fee".split()[: 3 + k % 3])]
    asked = [(d, n, q) for d in (1, 2, 3) for n, q in enumerate(["a1 b1", "supplier", "fee a0", "plier1", "nothing", "", None, "b0 sup- a1"])]
    quotes = spark.createDataFrame(asked + [(1, 0, "a1 b1")], "document long, quote_id int, quote string")
    tokens = located.positioned_tokens(located.laid_out_words(spark.createDataFrame(rows, SCAN)))
    raw = located.positioned_tokens(located.laid_out_words(spark.createDataFrame(rows, SCAN), None))
    wanted = located.quote_boxes(located.located_quotes(tokens, quotes), tokens)
    got = located.boxes_of_quotes(raw, quotes)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect())) != []
    assert got.schema == wanted.schema
    assert got._jdf.queryExecution().sparkPlan().toString().count("Scan ExistingRDD[document") == 2


CLAIM = "struct<fragment: string, quote: string, severity: string, comment: string, confidence: double>"


def test_only_quoted_evidence_becomes_a_finding(spark):
    text = "The buyer pays a penalty of 5 percent. The supplier waits for the money."
    chunks = spark.createDataFrame([(1, r, 1, text, text) for r in range(12)] + [(1, 1, 2, "Other words stand in this fragment.", text)], "document long, rule int, ordinal int, content string, page_text string")
    first, second = "buyer pays a penalty of 5 percent", "supplier waits for the money"
    claim = lambda q, f="F1", s="YELLOW", c=0.125: (f, q, s, "c", c)
    answers = [
        (1, 0, "RED", "NOT_FOUND", None, None),
        (1, 1, "YELLOW", "RISK", None, [claim(first, s="RED"), claim(first), claim(second, s="LOW"), claim("pays a fee that nobody has named"), claim(first, "F9"), claim(first, "F2"), claim("pays a"), claim(second, "F01")]),
        (1, 2, "RED", "OK", "fine", [claim(first), claim(second)]),
        (1, 3, "RED", "OK", "fine", [claim(first), claim("supplier waits for no money at all")]),
        (1, 4, "RED", "OK", "fine", [claim(first), claim(first, None)]),
        (1, 5, "RED", "UNKNOWN", "who knows", None),
        (1, 6, "RED", None, None, None),
        (1, 7, "RED", "RISK", None, []),
        (1, 8, "odd", "RISK", None, [claim(first)]),
        (2, 8, "RED", "RISK", None, [claim(first)]),
        (1, 9, "RED", "RISK", None, [claim(None), claim("5 percent. The supplier waits")]),
    ]
    found = drafts.drafts(spark.createDataFrame(answers, f"document long, rule int, rule_severity string, verdict string, explanation string, claims array<{CLAIM}>"), chunks)
    rows = sorted((r.document, r.rule, r.place, r.severity, r.reason or "", r.quote or "") for r in found.collect())
    assert rows == [
        (1, 1, 0, "YELLOW", "", first), (1, 1, 2, "LOW", "", second), (1, 1, 3, "UNKNOWN", "unverified", ""), (1, 1, 4, "UNKNOWN", "no_fragment", ""),
        (1, 1, 5, "UNKNOWN", "unverified", ""), (1, 1, 6, "UNKNOWN", "unverified", ""), (1, 1, 7, "UNKNOWN", "no_fragment", ""),
        (1, 2, 0, "GREEN", "", first), (1, 3, 0, "UNKNOWN", "unverified", ""), (1, 4, 0, "UNKNOWN", "no_fragment", ""),
        (1, 5, 0, "UNKNOWN", "undecided", ""), (1, 6, 0, "UNKNOWN", "broken", ""), (1, 7, 0, "UNKNOWN", "broken", ""),
        (1, 8, 0, "UNKNOWN", "no_severity", ""), (1, 9, 0, "UNKNOWN", "unverified", ""), (1, 9, 1, "YELLOW", "", "5 percent. The supplier waits"),
        (2, 8, 0, "UNKNOWN", "no_chunks", ""),
    ]
    kept = {(r.rule, r.place): (r.quote_verified, r.confidence, r.comment) for r in found.where("document = 1").collect()}
    assert kept[1, 0] == (True, 0.12, "c") and kept[2, 0] == (True, None, "fine") and kept[3, 0] == (False, None, None) and kept[5, 0][2] == "who knows"


def test_texts_of_a_rule_follow_its_title(spark):
    words = "title string, description string, new_title string, new_description string, query string, prompt string, vector array<double>"
    auto = spark.createDataFrame([("A", "b.", "C", "", "A. b", "own", [1.0]), ("A", "", "A", "", "A", None, [2.0]), ("A", "b", "C", "d", "own", None, [3.0])], words)
    made = [tuple(r) for r in drafts.retold_rules(auto).select("title", "query", "prompt", F.size("vector")).collect()]
    assert made == [("C", "C", "own", None), ("A", "A", None, 1), ("C", "own", None, 1)]
    assert auto.limit(1).select(drafts.embedding_text(F.lit(""), F.lit("x")), drafts.embedding_text(F.lit("t"), F.lit("x"))).first()[:] == ("x", "t\nx")


def test_history_and_labels_of_odd_rows(spark, tmp_path):
    events = spark.createDataFrame([("ANALYSIS_COMPLETED", '{"rules": 21, "critical": 12}'), ("RULE_TOGGLED", None), ("ANALYSIS_CREATED", '{"project": "", "documents": 1, "file": "x"}'), ("DOCUMENT_RENAMED", "{broken"), ("ODD", "{}"), (None, None)], "action string, details string")
    found = [(r.title, r.detail) for r in search.described(events, "action", "details").collect()]
    assert found == [("Проверка документа завершена", "21 правило · 12 критических замечаний · 0 требуют внимания"), ("Правило отключено", ""), ("Документ добавлен", "x"), ("Документ переименован", "None → None"), ("ODD", ""), (None, "")]
    files = spark.createDataFrame([("a.ZIP", 1, "x", None), ("a.pdf", 1, "a.pdf", "a.pdf"), ("a.pdf", 2, "a.pdf", "d/a.pdf"), (None, 1, None, None)], "upload string, n int, name string, path string")
    labels = files.select(reports.source_label(F.col("upload"), F.col("n")), reports.from_archive(F.col("upload"), F.col("name"), F.col("path"))).collect()
    assert [tuple(r) for r in labels] == [(reports.SOURCE_ARCHIVE, True), (reports.SOURCE_FILE, False), (reports.SOURCE_ARCHIVE, True), (reports.SOURCE_FILE, False)]
    for k in range(2):
        search.audited(str(tmp_path / "log"), spark.createDataFrame([(k, "ODD")], "user int, action string"))
    assert spark.read.parquet(str(tmp_path / "log")).where("at IS NOT NULL").count() == 2


def test_equal_rows_fit_one_by_one(spark):
    rows = spark.createDataFrame([("a", 1, "xx", 2)] * 3 + [("a", 2, None, None), ("a", 3, "y", 1), (None, 1, "zz", 2)], "k string, at int, text string, size int")
    found = sorted(((r.k or ""), r.at, r.text or "") for r in context.fitting(rows, "k", ["at"], "size", 5).collect())
    assert found == [("", 1, "zz"), ("a", 1, "xx"), ("a", 1, "xx"), ("a", 2, ""), ("a", 3, "y")]
