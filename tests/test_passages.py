"""Phrases and quotes in positioned tokens against slow versions, on small scans with gaps in them."""

from __future__ import annotations

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.operators import asof, located, passages, quotes
from lexweave.plans import passages as plans
from lexweave.plans import registry
from tests.oracle import same

TOKENS = "document long, position long, page long, token string, norm string, starts_line boolean, boxes array<struct<line:int,x0:double,y0:double,x1:double,y1:double>>, words array<string>"


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def slow_stretch(quote, text, least=quotes.FUZZY):
    if not quote or not text:
        return None
    if len(text) < len(quote):
        found = slow_stretch(text, quote, least)
        return found and (0, len(text), found[2])
    best = None
    for at in range(1 - len(quote), len(text)):
        start, end = max(0, at), min(len(text), at + len(quote))
        score = 200 * common(quote, text[start:end]) / (len(quote) + end - start)
        if score >= least and (best is None or score > best[2] + 1e-9):
            best = (start, end, score)
    return best


@pytest.mark.parametrize("least", [82, 60, 95])
def test_best_stretch_equals_all_stretches(least):
    rng, hits = random.Random(least), 0
    for n in range(150):
        text = "".join(rng.choice("abcde ") for _ in range(rng.randrange(0, 90)))
        at = rng.randrange(0, len(text) + 1)
        quote = "".join(c for c in text[at : at + rng.randrange(0, 30)] if rng.random() > 0.12) if n % 4 else "".join(rng.choice("abcde ") for _ in range(rng.randrange(0, 30)))
        quote += rng.choice(("", "", "xy"))
        found, slow = quotes.best_stretch(quote, text, least), slow_stretch(quote, text, least)
        assert (found and found[:2]) == (slow and slow[:2]), (quote, text)
        hits += found is not None
    assert hits > 20


def test_a_long_page_costs_in_proportion():
    rng = random.Random(3)
    words = [f"word{rng.randrange(300)}" for _ in range(12_000)]
    quote = " ".join(words[9000:9040]).replace("1", "one")
    counted = []
    for n in (3_000, 12_000):
        likeness, calls = quotes.Likeness.common, [0]

        def common_counted(self, start, end, inner=likeness, calls=calls):
            calls[0] += 1
            return inner(self, start, end)

        quotes.Likeness.common = common_counted
        try:
            quotes.best_stretch(quote, " ".join(words[:n]))
        finally:
            quotes.Likeness.common = likeness
        counted.append(calls[0])
    # most places of a page are passed over
    assert counted[1] < 8 * counted[0] + 100 and counted[1] < 0.2 * len(" ".join(words))


def test_many_stretches_are_compared_in_one_row(monkeypatch):
    rng, rows = random.Random(4), []
    monkeypatch.setattr(quotes, "LANES", 4096)
    commons = quotes.Likeness.commons
    monkeypatch.setattr(quotes.Likeness, "commons", lambda self, a, z: rows.append(int((z - a).sum())) or commons(self, a, z))
    text = "".join(rng.choice("abcdefgh ") for _ in range(6_000))
    assert quotes.best_stretch("".join(rng.choice("abcdefgh ") for _ in range(200)), text) is None
    # a row each for what begins near, none for each place; all of a page in a few times its length
    assert len(rows) < 20 and sum(rows) < 8 * len(text)
    quote = text[4000:4100] + "+" + text[4101:4200]
    assert quotes.best_stretch(quote, text) == (4000, 4200, 99.5)
    starts, ends = np.array([0, 3, 7]), np.array([0, 9, 11])
    likeness = quotes.Likeness("xyя𝄞y", "ax𝄞yyяxzyyzя")
    assert likeness.commons(starts, ends).tolist() == [common("xyя𝄞y", "ax𝄞yyяxzyyzя"[a:z]) for a, z in zip(starts, ends, strict=True)]


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_last_mark_equals_brute_force(spark, block):
    rng = random.Random(block)
    reach = {1: 5, 3: 0, 4096: 40}[block]
    marks = [(d, at, at + reach, f"m{at}") for d in (1, 2) for at in rng.sample(range(120), 25)]
    asks = [(d, rng.randrange(130), f"q{i}") for i in range(80) for d in (1, 2, 3)]
    found = asof.last_mark(spark.createDataFrame(asks, "document long, at long, ask string"), spark.createDataFrame(marks, "document long, at long, until long, mark string"), block)

    def wanted(d, at):
        before = max((m for m in marks if m[0] == d and m[1] <= at), key=lambda m: m[1], default=None)
        return before[3] if before and before[2] >= at else None

    assert sorted(map(tuple, found.collect()), key=str) == sorted(((d, at, q, wanted(d, at)) for d, at, q in asks), key=str)
    assert asof.last_mark(spark.createDataFrame([], "document long, at long"), spark.createDataFrame(marks, "document long, at long, until long, mark string")).count() == 0


# --- whole scans


def contract(rng, pages):
    """Tokens of a document as rows, one word each; some lines begin with a clause or a section."""
    rows, position = [], 0
    for page in range(1, pages + 1):
        for line in range(rng.randrange(1, 6)):
            words = [rng.choice(("alpha", "beta", "gamma", "delta", "Ёж,", "(omega)")) for _ in range(rng.randrange(1, 9))]
            head = rng.choice((None, None, "1.2", "3.", "12.5.", "7"))
            for i, w in enumerate([head, *words] if head else words):
                norm = w.lower().replace("ё", "е").strip(quotes.STRIP)
                rows.append((position, page, w, norm, i == 0, line, i))
                position += 1
    return rows


def slow_clause(tokens, first, last):
    for t in tokens[max(0, first - 599) : first + 1][::-1]:
        if t[4] and re.fullmatch(r"\d{1,2}(\.\d{1,3}){1,3}", t[3]):
            return t[3]
        if t[4] and re.fullmatch(r"\d{1,2}", t[3]) and t[2].endswith("."):
            break
    return next((t[3] for t in tokens[first : last + 1] if t[4] and re.fullmatch(r"\d{1,2}(\.\d{1,3}){1,3}", t[3])), None)


def slow_boxes(tokens):
    lines = {}
    for t in tokens:
        lines.setdefault((t[1], t[5]), []).append(t[6])
    return [(p, n, 10.0 * min(i), 10.0 * n, 10.0 * max(i) + 9, 10.0 * n + 9) for (p, n), i in sorted(lines.items())]


def slow_details(tokens, first, last):
    low, high = max(0, first - 12), min(len(tokens), last + 13)
    snippet = ("… " if low else "") + " ".join(t[2] for t in tokens[low:high]) + (" …" if high < len(tokens) else "")
    return tokens[first][1], slow_clause(tokens, first, last), " ".join(t[2] for t in tokens[first : last + 1]), snippet, slow_boxes(tokens[first : last + 1])


def frame_of(spark, contracts):
    rows = [(d, p, page, w, norm, start, [(line, 10.0 * i, 10.0 * line, 10.0 * i + 9, 10.0 * line + 9)], [w]) for d, tokens in contracts.items() for p, page, w, norm, start, line, i in tokens]
    return spark.createDataFrame(rows, TOKENS).repartition(3)


def details(r):
    return r.page, r.clause, r.text, r.snippet, [tuple(b) for b in r.boxes]


def test_phrases_equal_a_slow_search(spark):
    rng = random.Random(8)
    contracts = {d: contract(rng, 4) for d in range(6)}
    phrases = [(0, "alpha"), (1, "Beta, gamma"), (2, "alpha alpha"), (3, "a"), (4, "..."), (5, None), (6, "ma delt"), (7, "еж omega")]
    tokens = frame_of(spark, contracts)
    hits = passages.found_phrases(tokens, spark.createDataFrame(phrases, "q int, text string"), "q", 5)
    found = {(r.document, r.q, r.hit): (r.total, *details(r)) for r in passages.described(hits.withColumn("quote_id", F.struct("q", "hit")), tokens).collect()}
    wanted = {}
    for d, own in contracts.items():
        hay, starts = " ".join(t[3] for t in own), [0]
        for t in own:
            starts.append(starts[-1] + len(t[3]) + 1)
        for q, text in phrases:
            needle = " ".join(n for n in (w.lower().replace("ё", "е").strip(quotes.STRIP) for w in (text or "").split()) if n)
            spots = [m.start() for m in re.finditer(re.escape(needle), hay)] if needle else []
            for hit, at in enumerate(spots[:5]):
                first = max(i for i in range(len(own)) if starts[i] <= at)
                last = max(i for i in range(len(own)) if starts[i] < at + len(needle))
                wanted[d, q, hit] = (len(spots), *slow_details(own, first, last))
    assert found == wanted and len(wanted) > 60


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_phrases_are_described_where_they_are_found(spark):
    rng = random.Random(9)
    tokens = frame_of(spark, {d: contract(rng, 4) for d in range(6)})
    phrases = spark.createDataFrame([(f"p{i}", w) for i, w in enumerate(("alpha", "beta gamma", "a", "ma delt", "alpha", "nowhere", "..."))], "q string, text string")
    hits = passages.found_phrases(tokens, phrases, "q", 3).withColumn("quote_id", F.struct("q", "hit"))
    rows = lambda df: sorted((r.document, r.q, r.hit, r.total, r["first"], r["last"], details(r)) for r in df.collect())
    wanted = rows(passages.described(hits, tokens))
    assert len(wanted) > 40 and rows(passages.described_phrases(tokens, phrases, "q", 3)) == wanted
    # in blocks of phrases, each over all documents
    assert rows(passages.described_phrases(tokens, phrases, "q", 3, block=2)) == wanted


def test_only_texts_are_shuffled_for_phrases(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(d, "one two three\nfour five six\n" * 9) for d in range(40)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "two three four"), (2, "four five")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = registry.QUERIES["phrase_passages"](spark, str(tmp_path))
    exchanges = re.findall(r"(\w*Exchange) .*", plan_of(found))
    assert exchanges == ["Exchange"] and found.count() == 40 * 18
    # more text, more partitions: what a task sorts does not grow
    monkeypatch.setattr("lexweave.plans.drafted.PIECE", 100)
    assert re.findall(r"Exchange hashpartitioning\(document#\w+, (\d+)\)", plan_of(plans.contract_tokens(spark, str(tmp_path)))) == [str(-(-40 * 28 * 9 // 100))]


@pytest.mark.parametrize("query, shuffles", [("word_tokens", 1), ("page_scan_texts", 1), ("quote_boxes", 2)])
def test_words_of_scans_are_not_shuffled(spark, tmp_path, query, shuffles):
    spark.createDataFrame([(d, "one two three\nfour five six seven\n" * 9) for d in range(20)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    shuffled = re.findall(r"Exchange hashpartitioning\((\w+)#\w+, \d+\), (\w+)", plan_of(registry.QUERIES[query](spark, str(tmp_path))))
    assert [s for s in shuffled if s[1] == "REPARTITION_BY_NUM"] == [("document", "REPARTITION_BY_NUM")] * shuffles and not [s for s in shuffled if s[1] == "REPARTITION_BY_COL"]


def slow_hint(tokens, quote, page, page_end):
    wanted = [n for n in (w.lower().replace("ё", "е").strip(quotes.STRIP) for w in (quote or "").split()) if n]
    if not wanted:
        return None
    scopes = ([[t for t in tokens if page - 1 <= t[1] <= page_end + 1]] if page is not None else []) + [tokens]
    for k, scope in enumerate(scopes):
        norms = [t[3] for t in scope]
        for i in range(len(norms) - len(wanted) + 1):
            if norms[i : i + len(wanted)] == wanted:
                return True, scope[i][0], scope[i][0] + len(wanted) - 1, 100.0
        if k == 0 and page is not None and (found := slow_stretch(" ".join(wanted), " ".join(norms))):
            starts = [0]
            for n in norms:
                starts.append(starts[-1] + len(n) + 1)
            inside = [i for i in range(len(norms)) if starts[i + 1] - 1 > found[0] and starts[i] < found[1]]
            first = max(i for i in range(len(norms)) if starts[i] <= found[0])
            return False, scope[first][0], scope[inside[-1]][0] if inside else scope[first][0], round(found[2], 6)
    return None


def test_phrases_of_items_with_line_breaks(spark, tmp_path):
    docs = [(1, "\n".join(["one two three four", "some alpha beta gamma here", "and alpha beta", "x", "y", "alpha beta gamma"]))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, "alpha\nbeta gamma delta"), (2, " \tthree  four"), (3, "alone"), (4, ""), (5, None), (6, "some\n\nalpha zeta")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = registry.QUERIES["phrase_passages"](spark, str(tmp_path))
    assert {(r.item_id, r.hit): r.text for r in found.collect()}.keys() >= {(1, 0), (1, 1), (6, 0)}
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    same(found, db, registry.ORACLE_SQL["phrase_passages"])


def test_hints_equal_a_slow_search(spark):
    rng = random.Random(12)
    contracts = {d: contract(rng, 5) for d in range(5)}
    asked = []
    for i in range(120):
        d = rng.randrange(5)
        own = contracts[d]
        at = rng.randrange(len(own))
        words = [t[2] for t in own[at : at + rng.randrange(1, 12)]]
        if i % 3:
            words[rng.randrange(len(words))] = rng.choice(("", "other", "betta", "delta delta"))
        page = rng.choice((None, own[at][1], own[at][1] + 1, 2, 40))
        asked.append((d, i, " ".join(words), page, page and page + rng.choice((0, 1, 10**9, -1))))
    asked += [(0, 500, None, 1, 1), (0, 501, "...", 1, 1), (99, 502, "alpha", 1, 1)]
    tokens = frame_of(spark, contracts)
    found = passages.hinted_quotes(tokens, spark.createDataFrame(asked, "document long, quote_id int, quote string, page long, page_end long").repartition(2))
    got = {r.quote_id: (r.verified, r.first, r.last, round(r.score, 6)) for r in found.collect()}
    wanted = {i: h for d, i, quote, p, e in asked if d in contracts and (h := slow_hint(contracts[d], quote, p, e))}
    assert got == wanted
    assert sum(not h[0] for h in got.values()) > 10 and sum(h[0] for h in got.values()) > 10
    assert {r.quote_id: details(r) for r in passages.described(found, tokens).collect()} == {i: slow_details(contracts[next(d for d, q, *_ in asked if q == i)], h[1], h[2]) for i, h in wanted.items()}


def test_nothing_found_goes_through_the_driver(spark, tmp_path):
    rows = [(d, "\n".join(f"Line {n} of document {d} says what the buyer and the seller of these goods owe each other" for n in range(12))) for d in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    # small tables, which Spark would rather broadcast; their positions are many more rows than it takes into account
    plan = plan_of(registry.QUERIES["quote_hints"](spark, str(tmp_path)))
    assert re.findall(r"(\w*Exchange) .*", plan) == ["Exchange"] * 2
    tokens = plans.contract_tokens(spark, str(tmp_path)).localCheckpoint()
    quotes = plans.changed_lines(spark.read.parquet(str(tmp_path / "documents.parquet")).select(F.col("doc_id").alias("document"), "text"))
    found = passages.hinted_quotes(tokens, quotes).localCheckpoint()
    described = passages.described(found, tokens)
    assert "BroadcastExchange" not in plan_of(described)
    columns = ["document", "quote_id", "verified", "first", "last", "score", "page", "clause", "text", "snippet", "boxes"]
    assert sorted(map(str, described.select(columns).collect())) == sorted(map(str, passages.described_quotes(tokens, quotes).select(columns).collect()))
    assert found.count() > 40 and {r.verified for r in found.collect()} == {True, False}


def test_the_query_of_hints_equals_a_slow_search(spark, tmp_path):
    rng = random.Random(21)
    line = lambda: "Goods " + " ".join(rng.choice(("payment", "delivery", "penalty", "buyer", "seller", "Goods", "late.", "time,")) for _ in range(rng.randrange(6, 14)))
    rows = [(d, "\n".join(line() for _ in range(rng.randrange(1, 32)))) for d in range(7)] + [(7, None), (8, ""), (9, "short\n.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    tokens = plans.contract_tokens(spark, str(tmp_path))
    by_document = {}
    for t in tokens.orderBy("document", "position").collect():
        by_document.setdefault(t.document, []).append((t.position, t.page, t.token, t.norm))
    pages = spark.read.parquet(str(tmp_path / "documents.parquet")).select(F.col("doc_id").alias("document"), "text")
    wanted = {}
    for r in plans.changed_lines(pages).collect():
        if h := slow_hint(by_document.get(r.document, []), r.quote, r.page, r.page_end):
            wanted[r.document, r.quote_id] = (h[0], round(h[3], 4))
    found = {(r.document, r.quote_id): (r.verified, r.score) for r in registry.QUERIES["quote_hints"](spark, str(tmp_path)).collect()}
    assert found == wanted and {v[0] for v in found.values()} == {True, False}


def test_boxes_of_cut_words(spark):
    words = spark.createDataFrame([(1, 1, 0, "sup-", 0, 0.0, 0.0, 9.0, 9.0), (1, 1, 1, "plier", 1, 0.0, 10.0, 9.0, 19.0), (1, 1, 2, "pays", 1, 10.0, 10.0, 19.0, 19.0)], "document long, page long, at int, word string, line int, x0 double, y0 double, x1 double, y1 double")
    tokens = located.positioned_tokens(words)
    hits = passages.found_phrases(tokens, spark.createDataFrame([(1, "plier p")], "q long, text string"), "q")
    row = passages.described(hits.withColumn("quote_id", F.col("q")), tokens).first()
    assert (row.text, row.snippet, row.clause, len(row.boxes)) == ("sup- plier pays", "sup- plier pays", None, 2)
