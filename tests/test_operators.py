"""Operators on small cases of their own."""

from __future__ import annotations

import hashlib
import io
import random
import re
import zipfile
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.operators import context, dedup, evaluate, findings, quotes, reports, retrieval, search, structure
from lexweave.sources import uploads
from lexweave.streaming import feeds


@pytest.mark.parametrize(
    ("severities", "score", "light"),
    [("LOW", 3, "GREEN"), ("LOW YELLOW", 13, "YELLOW"), ("RED", 30, "RED"), ("RED UNKNOWN", None, "RED"), ("UNKNOWN", None, "UNKNOWN"), ("GREEN GREEN", 0, "GREEN"), ("RED RED RED YELLOW YELLOW YELLOW YELLOW YELLOW GREEN", 80, "RED")],
)
def test_score_and_light(spark, severities, score, light):
    rows = [(1, i, 1, s, "NEW", None) for i, s in enumerate(severities.split())]
    df = spark.createDataFrame(rows, "document long, line long, rule long, severity string, review_status string, page long")
    found = findings.severity_counts(df, "document").select(findings.score().alias("s"), findings.light().alias("l")).first()
    assert (found.s, found.l) == (score, light)


def test_dismissed_findings_are_no_risk(spark):
    df = spark.createDataFrame([(1, 1, 7, "RED", "DISMISSED", None)], "document long, line long, rule long, severity string, review_status string, page long")
    r = findings.severity_counts(df, "document").first()
    assert (r.critical, r.unseen, r.rules_checked) == (0, 0, 1)


@pytest.mark.parametrize("turned", [1, -1])
def test_findings_with_one_line_number_are_numbered_by_status(spark, turned):
    rows = [(1, 4, None, "YELLOW", s, 25, t) for s in ("CONFIRMED", "NEW", "RESOLVED") for t in ("a", "b")][::turned]
    found = spark.createDataFrame(rows, "document long, line long, rule long, severity string, review_status string, page long, text string").coalesce(1)
    rules = spark.createDataFrame([(7, 1)], "rule long, sort_order long")
    numbered = findings.renumbered(found, rules).orderBy("sort_index").collect()
    assert [(r.review_status, r.text) for r in numbered] == sorted((s, t) for *_, s, _, t in rows)


def test_mmr_prefers_a_different_item():
    alike = np.array([[1.0, 0.95, 0.1], [0.95, 1.0, 0.1], [0.1, 0.1, 1.0]])
    assert retrieval.mmr_order([0.9, 0.85, 0.5], alike, 2) == [0, 2]
    assert retrieval.mmr_order([0.9, 0.85], alike[:2, :2], 2) == [0, 1]


def test_mmr_matches_a_slow_version():
    rng = random.Random(3)
    for _ in range(100):
        n, k = rng.randrange(2, 9), rng.randrange(1, 5)
        scores = sorted((round(rng.random(), 2) for _ in range(n)), reverse=True)
        alike = np.array([[round(rng.random(), 1) for _ in range(n)] for _ in range(n)])
        alike = np.maximum(alike, alike.T)
        chosen = [0]
        if n <= k:
            chosen = list(range(n))
        while len(chosen) < min(k, n):
            values = {}
            for i in set(range(n)) - set(chosen):
                near = max(alike[i, j] for j in chosen)
                values[i] = 0.65 * scores[i] / (max(scores) or 1) - 0.35 * near - (2.0 if near >= 0.8 else 0.0)
            top = max(values.values())
            chosen.append(min(i for i, v in values.items() if v >= top - 1e-12))
        assert len(retrieval.mmr_order(scores, alike, k)) == len(chosen)
        assert retrieval.mmr_order(scores, alike, k)[:1] == chosen[:1]


def test_indel_ratio():
    assert retrieval.indel_ratio("abc", "abc") == 1.0
    assert retrieval.indel_ratio("abcd", "abed") == 0.75
    assert retrieval.token_set_similarity("a b c", "c b a") == 1.0


def test_features_are_hashed_once_and_words_of_many_texts_summed_together(monkeypatch):
    told = ["Оплата оплаты, 12 дней", None, "", "...", "a ab abc", "abc abcd abcde abcdef abcdefg " * 9, "x" * 40]

    def plain(text, dimension):
        vector = np.zeros(dimension)
        for token in re.findall(r"\w+", (text or "").lower()):
            padded = f"#{token}#"
            for name, w in [(f"w:{token[:6]}", 2.0), *[(f"g:{padded[i : i + 4]}", 1.0) for i in range(max(1, len(padded) - 3))]]:
                h = int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")
                vector[(h >> 1) % dimension] += w if h & 1 else -w
        vector = vector.astype(np.float32)
        norm = float(np.linalg.norm(vector))
        return (vector / np.float32(norm) if norm > 0 else vector).tolist()

    for tokens in (1, 4, retrieval.TOKENS):
        monkeypatch.setattr(retrieval, "TOKENS", tokens)
        for dimension in (1, 16, 1024):
            assert retrieval.hash_vectors(told, dimension).tolist() == [plain(t, dimension) for t in told]
    assert retrieval.hash_vectors([]).shape == (0, retrieval.DIMENSION)
    retrieval._place.cache_clear(), retrieval._features.cache_clear()
    retrieval.hash_vectors(["walking talking"])
    assert retrieval._place.cache_info().misses == 10 and retrieval._place.cache_info().hits == 4


@pytest.mark.parametrize("block, step", [(2048, 256), (2, 3)])
def test_ranks_in_steps_equal_a_slow_search(spark, monkeypatch, block, step):
    """Rows are looked at a few at a time, with repeated keys, equal values, and queries in blocks."""
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
    for name in ("STEP", "ROWS"):
        monkeypatch.setattr(retrieval, name, step)
    rng, words = random.Random(step), [f"слово{i}" for i in range(9)] + ["a_long_word", "tiny", "of"]
    items = [(i, " ".join(rng.choices(words, k=4)) if i else None) for i in range(6)] + [(5, "слово1")]
    told = [(rng.randrange(40), rng.choice((None, "", " ".join(rng.choices(words, k=7))))) for _ in range(60)]
    found = retrieval.lexical_ranks(spark.createDataFrame(items, "q long, text string"), spark.createDataFrame(told, "k long, text string").repartition(3), "q", "k", 4)
    stem = lambda t: [w[:6] for w in (t or "").split() if len(w) > 3]
    wanted = set()
    for q in range(6):
        own = {s for i, t in items if i == q for s in stem(t)}
        values = {k: sum(s in own for i, t in told if i == k for s in stem(t)) for k, _ in told}
        wanted |= {(q, k, -v, n + 1) for n, (v, k) in enumerate(sorted((-v, k) for k, v in values.items() if v)[:4])}
    assert {tuple(r) for r in found.collect()} == wanted and len(wanted) > 15

    vectors = [(i, [float(rng.randrange(-3, 4)) for _ in range(rng.choice((3, 4)))] if i % 9 else None) for i in range(50)] + [(50, [0.0] * 3), (51, [1.0, None, 2.0]), (52, [])]
    given = spark.createDataFrame(vectors, "k long, embedding array<float>")
    near = retrieval.vector_ranks(given.where("k % 5 = 1").withColumnRenamed("k", "q"), given.repartition(2), "q", "k", 3, 0.9)
    wanted = set()
    for q, u in vectors:
        if q % 5 == 1 and u and None not in u and any(u):
            gaps = [(round(1 - float(np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v)), 9), k) for k, v in vectors if v and None not in v and any(v) and len(u) == len(v)]
            wanted |= {(q, round(g, 6), n + 1) for n, (g, _) in enumerate(sorted(x for x in gaps if x[0] <= 0.9)[:3])}
    assert {(r.q, round(abs(r.distance), 6), r.vector_rank) for r in near.collect()} == {(q, abs(g), n) for q, g, n in wanted}

    texts = spark.createDataFrame(told, "k long, text string")
    assert [r.embedding for r in retrieval.hash_embeddings(texts, "k", "text", 16).collect()] == [retrieval.hash_vector(t, 16).tolist() for _, t in told]


def test_hash_vectors_have_length_one():
    assert abs(float(np.linalg.norm(retrieval.hash_vector("Some words"))) - 1) < 1e-6
    assert not retrieval.hash_vector(None).any()


CONTRACT = [(1, 1, "1. ПРЕДМЕТ ДОГОВОРА\n1.1. Поставщик обя-\nзуется поставить товар.\n31.12.2025 наступает срок\n1.2 Цена указана"), (1, 2, "продолжение пункта\n2. Ответственность сторон\n2.1. Неустойка 44-ФЗ")]


def test_segments_and_outline(spark):
    lines = structure.lines_of(spark.createDataFrame(CONTRACT, "document long, page long, text string"))
    parts = structure.segments(lines).orderBy("segment").collect()
    assert [p.clause for p in parts] == [None, "1.1", "1.2", None, "2.1"]
    assert "обязуется" in parts[1].text and parts[2].page_end == 2
    assert [p.section for p in parts][0] == "1. Предмет договора"
    assert structure.outline(structure.segments(lines)).count() == 2
    assert spark.createDataFrame(CONTRACT, "document long, page long, text string").select(structure.law_type(F.col("text")).alias("l")).where("page = 2").first().l == "44-FZ"


def test_page_paragraphs_carry_the_heading(spark):
    lines = structure.lines_of(spark.createDataFrame(CONTRACT, "document long, page long, text string"))
    second = structure.page_paragraphs(lines).where("page = 2").orderBy("paragraph").collect()
    assert (second[0].section, second[0].clause, second[0].text) == ("1. ПРЕДМЕТ ДОГОВОРА", "1.2", "продолжение пункта")
    assert (second[1].section, second[1].clause) == ("2. Ответственность сторон", "2.1")


def test_chunks_respect_limits(spark):
    rows = [(1, i, 1, 1, None, "A" if i < 30 else "B", f"Sentence {i}. " + "word " * (i % 60)) for i in range(60)] + [(2, 1, 1, 1, "1.1", None, "x" * 5000)]
    parts = spark.createDataFrame(rows, "document long, segment long, page long, page_end long, clause string, section string, text string")
    found = structure.chunks(parts).collect()
    assert max(len(c.content) for c in found) <= structure.MAX_CHARS
    squeeze = lambda s: re.sub(r"\s", "", s)
    for document in (1, 2):
        own = sorted((c for c in found if c.document == document), key=lambda c: c.chunk)
        assert squeeze("".join(c.content for c in own)) == squeeze("".join(r[6] for r in rows if r[0] == document))


@pytest.mark.parametrize(
    ("quote", "text", "verified"),
    [("цена 100 рублей", "Указана цена 100 рублей.", True), ("допускается замена", "Не допускается замена товара", False), ("цена 10 рублей", "Указана цена 100 рублей.", False), ("5 процентов", "штраф -5 процентов", False), ("исполнения договора", "срок испол-\nнения договора", True), ("1,5 процента", "1.5 процента", False), ("...", "...", False)],
)
def test_strict_quotes(spark, quote, text, verified):
    rows = [(1, quote, text, text), (2, quote, None, text), (3, quote, text, None), (4, None, text, text), (5, quote, "other", text), (6, quote, text, "other")]
    found = {r.k: r.verified for r in quotes.verify_quotes(spark.createDataFrame(rows, "k long, quote string, fragment string, page_text string")).collect()}
    assert found == {1: verified} | dict.fromkeys(range(2, 7), False)


def test_a_text_is_cut_into_lexemes_once_for_a_quote(spark):
    """Equal texts are one, and a way of reading that changes nothing is not taken: two cuts a way, of quote and text."""
    texts = ["не цена", "цена", "Цена 7%", "-7 %", "+7", "7", "сро-\nка цена", "срока", "со\u00adгласие", "согласие", "без-\nопасно", "\\E a.b", "a.b", "_x", "𝔸 b", "b"]
    rows = [(f"{i}/{j}/{k}", q, t, t if k else f"{t} {q}") for i, q in enumerate(texts) for j, t in enumerate([*texts, " ".join(texts), "\n".join(texts)]) for k in (0, 1)]
    asked = spark.createDataFrame(rows, "id string, quote string, fragment string, page_text string")

    def plain(row, join_wraps):
        line = lambda c: quotes.lexeme_line(F.col(c), join_wraps)
        before = F.when(line("quote").rlike(r"^\n[\p{Nd}²³¹⁰⁴-⁹₀-₉]"), F.lit(f"(?<!{quotes.SIGN})")).otherwise(F.lit(""))
        return F.rlike(line(row), F.concat(F.lit(f"(?<!{quotes.NEGATION})"), before, F.lit("\\Q"), line("quote"), F.lit("\\E")))

    says = F.regexp_replace("quote", quotes.SOFT_HYPHEN, "").rlike(r"[\p{L}\p{N}]")
    wanted = says & ((plain("fragment", False) & plain("page_text", False)) | (plain("fragment", True) & plain("page_text", True)))
    found = quotes.verify_quotes(asked.withColumn("wanted", wanted))
    rows = found.select("id", "verified", "wanted").collect()
    assert [r.id for r in rows if r.verified != r.wanted] == [] and len({r.verified for r in rows}) == 2
    plan = quotes.verify_quotes(asked)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 4


def test_quotes_over_pages(spark):
    pages = spark.createDataFrame([(1, 1, "Срок испол-"), (1, 2, "нения договора"), (1, 3, "иное")], "document long, page long, text string")
    asked = spark.createDataFrame([(1, 1, 1, 2, "исполнения договора"), (1, 2, 2, 3, "исполнения договора"), (1, 3, 9, 9, "иное")], "document long, quote_id long, page long, page_end long, quote string")
    rows = quotes.with_page_texts(asked, pages).withColumn("fragment", F.lit("Срок испол-\nнения договора, иное"))
    assert {r.quote_id: r.verified for r in quotes.verify_quotes(rows).collect()} == {1: True, 2: False, 3: False}


def _rule(spark, **more):
    row = {"rule": "r", "severity": "RED", "title": "T", "description": "D", "query": "срок поставки товара", "prompt": "Рекомендация: продлить срок", "marker": None, "exception": None, "guard": None} | more
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))


def test_keyword_sensitivities_nest(spark):
    chunks = [(1, "r", 0, "Срок поставки товара составляет 3 дня с момента заявки.", 0.5, True), (2, "r", 0, "Поставка возможна по частям в любое время года.", 0.4, True), (3, "r", 0, "Совсем другое условие без общих слов здесь.", 0.1, False)]
    df = spark.createDataFrame(chunks, "document long, rule string, chunk long, content string, score double, fts_hit boolean")
    rules = _rule(spark, marker=r"(?iU)составляет\s+[1-5]\s+дн\w+")
    found = {s: {r.document: r for r in evaluate.keyword_findings(df, rules, s).collect()} for s in evaluate.SENSITIVITIES}
    assert [sorted(found[s]) for s in evaluate.SENSITIVITIES] == [[1], [1, 2], [1, 2, 3]]
    assert (found["balanced"][1].severity, found["balanced"][2].severity) == ("RED", "YELLOW")
    assert found["balanced"][1].proposal == "продлить срок"


def test_marker_patterns_compile(spark):
    table = evaluate.pattern_table(spark)
    text = F.lit("Обеспечение: безакцептное списание. Штраф в размере 10% от цены")
    hits = {r.rule for r in table.where(F.expr("marker IS NOT NULL")).withColumn("t", text).where(F.expr("t rlike marker")).collect()}
    assert {"unconditional_bg_claim", "unreasonable_penalty"} <= hits


def test_noise_at_55_letters_in_100(spark):
    texts = ["a" * n + "1 " * (m - n) for m in range(1, 201) for n in {55 * m // 100 + d for d in (-1, 0, 1)} if 0 <= n <= m]
    found = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("noise", evaluate.is_noise(F.col("text"))).collect()
    wanted = {t: 100 * t.count("a") < 55 * len(t.replace(" ", "")) for t in texts}
    assert {r.text: r.noise for r in found} == wanted


def test_guards(spark):
    rows = [("RED", "Раздел 5", "c", 0.9), ("RED", "A sentence that is long enough.", "нарушений: риск не выявлен", 0.9), ("RED", "A sentence that is long enough.", "c", 0.1), ("RED", "A sentence that is long enough.", "c", 0.9), ("GREEN", None, "c", None)]
    df = spark.createDataFrame(rows, "severity string, quote string, comment string, confidence double")
    assert evaluate.guarded(df).count() == 2


def _draft(seq, quote, severity="RED", **more):
    return {"document": 1, "seq": seq, "severity": severity, "title": f"t{seq}", "reference": None, "comment": f"c{seq}", "proposal": None, "page": 1, "clause": None, "quote": quote, "boxes": [], "verified": False, "confidence": None} | more


def test_merge_takes_two_passes(spark):
    rows = [_draft(1, "aaa bbb ccc"), _draft(2, "xxx yyy zzz"), _draft(3, "aaa bbb ccc xxx yyy zzz"), _draft(4, "aaa bbb ccc", "GREEN")]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], dedup.FIELDS)
    assert dedup.merged_findings(df, passes=1).count() == 3
    twice = dedup.merged_findings(df).orderBy("seq").collect()
    assert sorted(tuple(sorted(r.merged)) for r in twice) == [(1, 2, 3), (4,)]
    assert {r.severity for r in twice} == {"RED", "GREEN"}


def test_same_dotted_clause_merges(spark):
    rows = [_draft(1, "one two three", clause="п. 5.1"), _draft(2, "four five six", "YELLOW", clause="5.1", proposal="p"), _draft(3, "seven eight nine", clause="5", page=None)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], dedup.FIELDS)
    found = dedup.merged_findings(df).orderBy("seq").collect()
    assert [sorted(r.merged) for r in found] == [[1, 2], [3]]
    assert found[0].severity == "RED" and found[0].proposal == "p" and "t2" in found[0].comment


def test_far_page_is_found(spark):
    pages = [(1, p, "filler text " * 400) for p in range(1, 101)] + [(1, 101, "неустойка за просрочку поставки")]
    df = spark.createDataFrame(pages, "document long, page long, text string")
    asked = spark.createDataFrame([(1, 1, "какая неустойка за просрочку", None)], "document long, question long, text string, selected_page long")
    kept = context.budgeted_passages(context.passage_scores(df, asked), budget=8000).collect()
    assert 101 in {r.page for r in kept} and sum(len(r.content) for r in kept) <= 8000


def test_fitting_skips_what_is_too_large(spark):
    df = spark.createDataFrame([(1, 1, 50), (1, 2, 80), (1, 3, 40), (1, 4, 20)], "k long, o long, size long")
    assert [r.o for r in context.fitting(df, "k", ["o"], "size", 100).orderBy("o").collect()] == [1, 3]


def test_archives(spark):
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.pdf", b"%PDF-1")
    with zipfile.ZipFile(outer, "w") as z:
        for name in ("a.docx", "../evil.pdf", "__MACOSX/x.pdf", "~$b.docx", "note.exe"):
            z.writestr(name, b"x")
        z.writestr("inner.zip", inner.getvalue())
    df = spark.createDataFrame([("u.zip", bytearray(outer.getvalue())), ("bad.zip", bytearray(b"nothing"))], "path string, content binary")
    rows = {(r.path, r.member): r for r in uploads.exploded_archives(df).collect()}
    assert {m for p, m in rows if p == "u.zip"} == {"a.docx", "note.exe", "inner.zip/deep.pdf"}
    assert rows["u.zip", "a.docx"].supported and not rows["u.zip", "note.exe"].supported
    assert rows["bad.zip", ""].error == "not a ZIP"


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def test_archives_in_archives():
    third = zipped([("d.pdf", b"4")])
    second = zipped([("c.pdf", b"3"), ("n3.zip", third)])
    first = zipped([("b.pdf", b"2"), ("n2.zip", second)])
    outer = zipped([("n1.zip", first), ("/abs/A.pdf", b"1")])
    assert [p for p, _ in uploads.unpack(outer, 300, 10**6)] == ["abs/A.pdf", "n1.zip/b.pdf", "n1.zip/n2.zip/c.pdf"]
    for files, size, reason in ((5, 10**6, "too many files"), (300, 100, "too large")):
        with pytest.raises(uploads.Refused, match=reason):
            uploads.unpack(outer, files, size)
    assert len(uploads.unpack(outer, 6, 10**6)) == 3
    locked = bytearray(zipped([("a.pdf", b"1"), ("b.pdf", b"2")]))
    at = locked.rindex(b"PK\x01\x02") + 8
    locked[at] |= 1
    with pytest.raises(uploads.Refused, match="encrypted"):
        uploads.unpack(bytes(locked), 300, 10**6)


def test_phrases_inside_longer_words(spark):
    texts = spark.createDataFrame([(1, "Unterlagen, die Lage der Anlagen"), (2, "lage lagelage\n«Die» LAGE der"), (3, None), (4, "ababab abab")], "d long, text string")
    phrases = spark.createDataFrame([("p", "lage"), ("q", "die lage d"), ("r", "..."), ("s", "abab"), ("t", "Lage")], "q string, text string")
    wanted = {(1, "p"): [5, 15, 26], (1, "q"): [11], (2, "p"): [0, 5, 9, 18], (2, "q"): [14], (4, "s"): [0, 7]}
    wanted |= {(d, "t"): at for (d, p), at in wanted.items() if p == "p"}
    for block in (2, 100):
        hits = quotes.phrase_hits(texts, phrases, "d", "q", block=block).collect()
        assert {(r.d, r.q): r.positions for r in hits} == wanted and all(r.total == len(r.positions) for r in hits)


def test_fingerprints_tell_nulls_and_separators_apart(spark):
    rows = [("a", "x|y", "z"), ("b", "x", "y|z"), ("c", None, "z"), ("d", "", "z"), ("e", "x|y", "z")]
    found = {r.k: r.fingerprint for r in context.fingerprint(spark.createDataFrame(rows, "k string, u string, v string"), "k", ["u", "v"]).collect()}
    assert len(set(found.values())) == 4 and found["a"] == found["e"]


def test_upload_checks(spark):
    rows = [("a.pdf", 9, bytearray(b"junk%PDF-1")), ("b.pdf", 4, bytearray(b"nope")), ("c.exe", 1, bytearray(b"x")), ("d.docx", 0, bytearray(b""))]
    df = spark.createDataFrame(rows, "path string, length long, content binary")
    assert [r.reason for r in uploads.checked_uploads(df).orderBy("path").collect()] == [None, "wrong content", "unsupported", "empty"]


def test_replaced_snapshot_is_idempotent(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    part = spark.createDataFrame([(2, "c"), (2, "d")], "k long, v string")
    once = uploads.replaced(table, part, ["k"])
    assert sorted(once.collect()) == sorted(uploads.replaced(once, part, ["k"]).collect())


def test_search_helpers(spark):
    assert search.severities("critical, Warning") == ["RED", "YELLOW"] and search.severities("") is None
    with pytest.raises(ValueError, match="unknown"):
        search.severities("loud")
    df = spark.createDataFrame([("file10.pdf",), ("file9.pdf",)], "n string")
    assert [r.n for r in df.orderBy(search.natural_key(F.col("n"))).collect()] == ["file9.pdf", "file10.pdf"]
    assert [r.f for r in spark.createDataFrame([(1,), (3,), (11,), (25,)], "n int").select(search.plural(F.col("n"), "файл", "файла", "файлов").alias("f")).collect()] == ["файл", "файла", "файлов", "файлов"]


def test_report_helpers(spark):
    df = spark.createDataFrame([("=1+1",), ("plain",), ("\t-x",)], "c string")
    assert [r.c for r in df.select(reports.guarded_cell(F.col("c")).alias("c")).collect()] == ["'=1+1", "plain", "'\t-x"]
    parts = spark.createDataFrame([("Text\n\n[Дополнительный риск: R (L)] more",)], "c string").select(reports.comment_parts(F.col("c")).alias("p")).first().p
    assert [(p.label, p.text) for p in parts] == [(None, "Text"), ("R (L)", "more")]
    cut = spark.createDataFrame([("aXbxc",)], "c string").select(reports.highlighted(F.col("c"), "x").alias("p")).first().p
    assert [(p.text, p.hit) for p in cut] == [("a", False), ("X", True), ("b", False), ("x", True), ("c", False)]


def test_notifications(spark):
    t = [datetime(2025, 1, 1, h) for h in range(5)]
    rows = [("f", t[0], "processing", None, 0), ("f", t[1], "processing", None, 0), ("f", t[2], "ready", None, 2), ("f", t[3], "ready", None, 2), ("g", t[0], "ready", None, 1)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, phase string, error string, critical int")
    assert [(r.k, r.ts, r.kind) for r in feeds.notifications(df, "k", ["ts"]).collect()] == [("f", t[2], "critical")]


def test_mmr_by_vectors_equals_the_loop(spark):
    rng = random.Random(31)
    rows = []
    for q in range(30):
        for k in rng.sample(range(40), rng.randrange(1, 11)):
            vector = None if rng.random() < 0.1 else [float(rng.randrange(-2, 3)) for _ in range(3)]
            rows.append((q, k, rng.choice((0.0, 0.25, 0.5, 0.75)), vector))
    candidates = spark.createDataFrame(rows, "q long, k long, score double, embedding array<double>")
    for top_k in (0, 1, 4):
        wanted = []
        for q in range(30):
            own = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))
            alike = np.zeros((len(own), len(own)))
            for i, a in enumerate(own):
                for j, b in enumerate(own):
                    if a[3] and b[3] and any(a[3]) and any(b[3]):
                        alike[i, j] = round(max(0.0, min(1.0, float(np.dot(a[3], b[3])) / float(np.linalg.norm(a[3]) * np.linalg.norm(b[3])))), 9)
            wanted += [(q, own[i][1], own[i][2], n) for n, i in enumerate(retrieval.mmr_order([r[2] for r in own], alike, top_k))]
        assert sorted(map(tuple, retrieval.mmr_by_vectors(candidates, "q", "k", top_k).collect())) == sorted(wanted)


@pytest.mark.parametrize("seed", range(3))
def test_duplicate_pairs_equal_all_pairs(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"слово{chr(1072 + i)}" for i in range(14)]
    rows = []
    for document in (1, 2, None):
        for seq in range(40):
            words = rng.sample(vocabulary, rng.randint(0, 12))
            quote = rng.choice([" ".join(words), None]) if not words else " ".join(words)
            rows.append((document, seq, rng.choice(["RED", "YELLOW", "LOW", "GREEN", None]), quote, rng.choice([None, "", "п. 3", "3.1", "раздел 3.1"]), rng.choice([None, 1, 2])))
    frame = spark.createDataFrame(rows, "document long, seq long, severity string, quote string, clause string, page long")
    found = {(r["document"], r["a"], r["b"]): r["overlap"] for r in dedup.duplicate_pairs(frame).collect()}

    wanted = {}
    for d, a, severity, quote, clause, page in rows:
        for e, b, other_severity, other, other_clause, other_page in rows:
            if d is None or d != e or a >= b or not {severity, other_severity} <= {"RED", "YELLOW", "LOW"}:
                continue
            x, y = (set((t or "").split()) for t in (quote, other))
            share = len(x & y) / min(len(x), len(y)) if x and y else 0.0
            key, other_key = ((c or "").removeprefix("п. ").removeprefix("раздел ") or None for c in (clause, other_clause))
            one_page = page is None or other_page is None or page == other_page
            if share >= 0.7 or (key and key == other_key and (one_page if "." in key else share >= 0.35)):
                wanted[d, a, b] = round(share, 4)
    assert found == wanted
    assert wanted


def test_pairs_read_stored_risks_and_order_words_once(spark):
    """What the pairs read several times is stored words, not quotes; both sides of their join share one order of words."""
    rows = [(1, k, "RED", 1, "1.1" if k % 2 else None, f"alpha beta gamma{k % 3} delta") for k in range(8)] + [(1, 8, "GREEN", 1, None, "alpha beta gamma0 delta")]
    frame = spark.createDataFrame(rows, "document long, seq long, severity string, page long, clause string, quote string")
    stored = dedup.keyed_risks(frame).localCheckpoint()
    pairs = dedup.pairs_of(stored)
    found = sorted(map(tuple, pairs.collect()))
    assert found == sorted(map(tuple, dedup.duplicate_pairs(frame).collect())) and len(found) == 28
    plan = pairs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "regexp_extract_all" not in plan and plan.count("collect_list") == 2 and "ReusedExchange" in plan
