"""Uploads, archives, answers, markers and ownership on small tables with awkward rows."""

from __future__ import annotations

import io
import json
import random
import time
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexweave.operators import answers, evaluate, search
from lexweave.sources import uploads
from lexweave.streaming import feeds

ISSUE = {"fragment": "F1", "quote": "q", "severity": "RED", "summary": "s", "comment": "c", "recommendation": "r", "confidence": 1}
BARE = {"verdict": "UNKNOWN", "issues": [], "evidence": [], "explanation": " e "}
RISK = BARE | {"verdict": "RISK", "issues": [ISSUE]}
OK = BARE | {"verdict": "OK", "evidence": [{"fragment": "F12", "quote": ""}]}


def risk(**changes):
    return json.dumps(RISK | {"issues": [ISSUE | changes]})


@pytest.mark.parametrize(
    ("text", "refusal"),
    [
        (json.dumps(RISK), None), (json.dumps(OK), None), (json.dumps(BARE), None), (f"x ```json\n{json.dumps(BARE)}\n``` y", None), (f"a {json.dumps(BARE)} b", None), (f"``` {json.dumps(OK)}``` and ```{{}}```", None),
        (risk(confidence=0), None), (risk(fragment="F12345678901"), None), (risk(quote="q" * 3000), None), (risk(summary=" " + "s" * 255), None),
        (None, "no JSON"), ("", "no JSON"), ("{", "no JSON"), ("}{", "no JSON"), ("3", "no object"), ("[{}", "fields"), ("[" * 100_000, "no JSON"), ('{"a": ' + "9" * 5000 + "}", "no JSON"),
        ('{"verdict": 1, "verdict": 2}', "repeated key"), ('{"a": {"b": 1, "b": 1}}', "repeated key"), ('{"a": NaN}', "number not finite"), ('{"a": -Infinity}', "number not finite"), ('{"a": 1e999}', "fields"),
        ("{}", "fields"), (json.dumps(BARE | {"x": 1}), "fields"), (json.dumps({k: v for k, v in BARE.items() if k != "issues"}), "fields"),
        (json.dumps(BARE | {"verdict": "ok"}), "verdict"), (json.dumps(BARE | {"verdict": ["OK"]}), "verdict"), (json.dumps(BARE | {"issues": None}), "issues"), (json.dumps(BARE | {"evidence": {}}), "evidence"),
        (json.dumps(RISK | {"issues": [ISSUE] * 4}), "issues"), (json.dumps(OK | {"evidence": [{"fragment": "F1"}]}), "evidence"), (json.dumps(OK | {"evidence": ["F1"]}), "evidence"),
        (risk(confidence=True), "issues"), (risk(confidence="0.5"), "issues"), (risk(confidence=1.01), "issues"), (risk(confidence=10**400), "issues"), (risk(severity="GREEN"), "issues"), (risk(severity=None), "issues"), (risk(summary=" "), "issues"), (risk(summary="s" * 256), "issues"),
        (risk(comment=3), "issues"), (risk(fragment="F0"), "issues"), (risk(fragment="F1\n"), "issues"), (risk(fragment="F123456789012"), "issues"), (risk(quote="q" * 3001), "issues"), (risk(more=1), "issues"), (risk(quote="\ud800"), "issues"),
        (json.dumps(BARE | {"explanation": ""}), "explanation"), (json.dumps(BARE | {"explanation": "x" * 3001}), "explanation"),
        (json.dumps(BARE | {"verdict": "RISK"}), "verdict and lists"), (json.dumps(BARE | {"verdict": "OK"}), "verdict and lists"), (json.dumps(RISK | {"verdict": "OK"}), "verdict and lists"), (json.dumps(OK | {"verdict": "NOT_FOUND"}), "verdict and lists"), (json.dumps(RISK | {"evidence": OK["evidence"]}), "verdict and lists"),
    ],
)
def test_answers(text, refusal):
    try:
        found = answers.typed_answer(text)
    except answers.Refused as refused:
        assert str(refused) == refusal
    else:
        assert refusal is None and found["explanation"] == "e"


def test_answers_as_columns(spark):
    rows = spark.createDataFrame([(1, json.dumps(RISK), "x"), (2, None, "y"), (3, json.dumps(OK), "z")], "k int, told string, refusal string")
    found = answers.typed_answers(rows, "told")
    assert found.columns == ["k", "told", "verdict", "explanation", "issues", "evidence", "refusal"]
    one, two, three = sorted(found.collect())
    assert (one.verdict, one.issues[0].confidence, one.issues[0].summary, one.evidence, one.refusal) == ("RISK", 1.0, "s", [], None)
    assert (two.verdict, two.issues, two.refusal, three.evidence[0].fragment) == (None, None, "no JSON", "F12")
    assert answers.typed_answers(rows.where("false"), "told").count() == 0


# --- uploads


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


@pytest.mark.parametrize(
    ("name", "path"),
    [("a/b.pdf", "a/b.pdf"), ("/abs\\b.pdf", "abs/b.pdf"), ("a/../b.pdf", None), ("c:/b.pdf", None), ("x/c:d?.pdf", "x/c_d_.pdf"), (" .a. /.. ./b.", "a/file/b"), ("x/~$a.doc", None), ("__MACOSX/a", None), ("x/.DS_Store", "x/DS_Store"), ("", None), ("./", None), ("a" * 300, "a" * 200), ("д\x01.pdf", "д_.pdf")],
)
def test_names_of_members(name, path):
    assert uploads.safe_path(name) == path


def test_shares_of_an_archive_add_up(spark):
    members = [(f"m{i:02}.txt", b"x" * (i * 37 % 101)) for i in range(40)]
    nested = zipped([(f"n{i}.pdf", b"y" * 50) for i in range(5)])
    files = [("a.zip", bytearray(zipped([*members, ("in.zip", nested)]))), ("b.zip", bytearray(zipped([]))), ("c.zip", None), ("d.zip", bytearray(b"")), ("e.zip", bytearray(zipped([("z.txt", b"")])))]
    df = spark.createDataFrame(files, "path string, content binary")
    wanted = sorted([("a.zip", n, len(c), None, c) for n, c in members] + [("a.zip", f"in.zip/n{i}.pdf", 50, None, b"y" * 50) for i in range(5)] + [("e.zip", "z.txt", 0, None, b""), ("b.zip", "", 0, "no files", None), ("c.zip", "", 0, "not a ZIP", None), ("d.zip", "", 0, "not a ZIP", None)], key=str)
    for share in (1, 100, 10**9):
        found = uploads.exploded_archives(df, share_bytes=share).select("path", "member", "size", "error", "content").collect()
        assert sorted([(*r[:4], None if r.content is None else bytes(r.content)) for r in found], key=str) == wanted
    assert uploads.exploded_archives(df.where("false")).count() == 0


def test_a_large_archive_goes_to_several_tasks(spark):
    content = zipped([(f"m{i}.txt", b"x" * 1000) for i in range(30)])
    df = spark.createDataFrame([("a.zip", bytearray(content))], "path string, content binary")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        placed = uploads.exploded_archives(df, share_bytes=5000).select("member", F.spark_partition_id().alias("task"))
        assert placed.count() == 30 and placed.select("task").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_stream_of_uploads_equals_the_batch(spark, tmp_path):
    folder = tmp_path / "up" / "deep"
    folder.mkdir(parents=True)
    files = {"a.zip": zipped([("x.txt", b"1"), ("y.exe", b"2")]), "b.pdf": b"junk %PDF", "c.pdf": b"none", "d.odd": b"x", "e.zip": b"PK none", "g.rtf": b"{\\rtf1"}
    for name, data in files.items():
        (folder / name).write_bytes(data)
    batch = uploads.uploaded_documents(uploads.read_files(spark, str(tmp_path / "up")))
    stream = uploads.uploaded_documents(uploads.file_stream(spark, str(tmp_path / "up"), max_bytes=10))
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    tidy = lambda df: sorted([(r.path.rsplit("/", 1)[1], r.member, r.size, r.supported, r.error) for r in df.collect()])
    found = tidy(spark.read.parquet(str(tmp_path / "out")))
    assert found == tidy(batch) and len(found) == 7
    assert {f[0]: f[4] for f in found if f[4]} == {"c.pdf": "wrong content", "d.odd": "unsupported", "e.zip": "not a ZIP"}


# --- markers, ownership, searches


@pytest.mark.parametrize(
    ("text", "marked", "allowed"),
    [
        ("Товар поставляется: поставка\nв течение 3 (трёх) рабочих дней.", ["defect_fix_deadline", "short_delivery_time"], []), ("Поставка в течение 13 дней", [], []), ("CISCO, или эквивалент", [], []), ("Oracle без замены", ["brand_without_equivalent"], []),
        ("Штраф в размере 5,5 (пяти с половиной) процентов", ["unreasonable_penalty"], []), ("штраф в размере 4 %", [], []), ("обеспечение исполнения 15 процентов", [], ["contract_security_excessive"]), ("обеспечение исполнения 155 процентов", [], []), ("лот 1875", [], ["national_regime"]), ("лот 18750", [], []), ("", [], []), (None, None, None),
    ],
)
def test_fixed_markers(spark, text, marked, allowed):
    row = spark.createDataFrame([(text,)], "t string").select(evaluate.marked_rules(F.col("t")).alias("m"), evaluate.allowed_rules(F.col("t")).alias("a")).first()
    assert (row.m or [], row.a or []) == (marked or [], allowed or [])


def test_markers_are_those_of_the_table(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(("Безакцептное списание", "Cisco или эквивалент", "Cisco", "товарный знак"))], "k int, t string")
    table = evaluate.pattern_table(spark)
    joined = texts.crossJoin(table).where("t rlike marker AND NOT coalesce(t rlike exception, false)").groupBy("k").agg(F.array_sort(F.collect_list("rule")).alias("rules"))
    own = texts.select("k", evaluate.marked_rules(F.col("t")).alias("rules")).where(F.size("rules") > 0)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, own.collect())) == [(0, ["unconditional_bg_claim"]), (2, ["brand_without_equivalent"])]


def test_ownership_and_status(spark):
    parents = spark.createDataFrame([(1, 7), (2, None), (3, 8)], "p int, who int")
    children = spark.createDataFrame([(10, 1), (11, 2), (12, 3), (13, None), (14, 9), (15, 1)], "c int, p int")
    mine = lambda **kw: sorted(r.c for r in search.owned_through(children, parents, "p", "who", 7, **kw).collect())
    assert mine() == [10, 11, 15] and mine(admin=True) == [10, 11, 12, 15]
    files = spark.createDataFrame([("Alpha", "a.pdf", "READY"), ("beta", None, "READY"), (None, "ALPHA.zip", "FAILED")], "t string, f string, s string")
    found = lambda *a: sorted(str(r.t) for r in search.uploads_matching(files, *a, ["t", "f"], "s").collect())
    assert found("alpha", None) == ["Alpha", "None"] and found("alpha", "ready") == ["Alpha"] and found(None, "failed") == ["None"] and len(found("", "")) == 3


# --- notices


def slow_notices(rows, kept):
    """(account, file, at, event, kind) of the newest of each account."""
    out, last = {}, {}
    for account, file, at, event, phase, error, critical in sorted(rows, key=lambda r: (r[2], r[3])):
        before, error = last.get((account, file)), error or ""
        last[account, file] = (phase, error)
        if before:
            ran = before[0] in feeds.RUNNING
            tests = (phase in feeds.FINISHED and error and (ran or error != before[1]), ran and phase == "ready" and not error, ran and phase == "ready" and critical > 0)
            out.setdefault(account, []).extend((account, file, at, event, k) for k, test in enumerate(tests) if test)
    return sorted(x for found in out.values() for x in found[-kept:])


def test_notices_of_a_stream_equal_those_of_the_batch(spark, tmp_path):
    rng, start = random.Random(14), datetime(2025, 1, 1)
    rows = [(rng.randrange(3), rng.randrange(5), start + timedelta(seconds=n, microseconds=n), n, rng.choice(("uploaded", "queued", "processing", "ready", "failed")), rng.choice((None, "", "a", "b")), rng.randrange(3)) for n in range(400)]
    schema = "account long, file long, ts timestamp, event long, phase string, error string, critical int"
    df = spark.createDataFrame(rows, schema)
    wanted = slow_notices(rows, 7)
    found = feeds.last_notices(feeds.notices(df, ["account", "file"], ["ts", "event"]), "account", "file", ["ts", "event", "kind"], 7)
    assert sorted((r.account, r.file, r.ts, r.event, r.kind) for r in found.collect()) == wanted and len(wanted) == 21
    for part in range(4):  # files of a stream, taken one by one
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    rings = feeds.notice_rings(stream, "account", "file", "ts", "event", 7)
    query = rings.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.agg(F.max(F.size("ring"))).first()[0] <= 7 < written.agg(F.max("n")).first()[0]
    kept = feeds.last_of_rings(written, "account", "file", 7)
    assert sorted((r.account, r.file, r["at"], r.event, r.kind) for r in kept.collect()) == wanted
