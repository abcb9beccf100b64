"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

One first-order model describes random strings, another ordinary identifiers. A run of identifier characters, less what
a pattern matched in it, is judged as a whole and, if it fails, by the stretches of good pieces between its separators;
one whose log-likelihood ratio is high enough in the mean and in sum is a span of kind ``random``. The labels come from the fixed
patterns: the values they match are random strings, and the short runs around them in a bounded sample of documents
are ordinary.
All of it is DataFrame functions.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import spans as S
from lexweave.llm.common import stage, table

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]++"
#: A run of hex digits is maximal, so runs of under 32 need not be matched at all.
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: Runs that train the model of ordinary identifiers: longer ones are what it has to judge.
SHORT = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{4,19}+(?![A-Za-z0-9+/_=-])"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Expected number of documents, chosen by a hash of their text, whose ordinary runs train the model.
TRAIN_DOCS = 400
#: Added to each character's count: unseen ones stay possible, and a model without samples is uniform.
SMOOTH = 0.5
#: Pairs of a first character that the frequency of the second one is worth.
BACKOFF = 16.0
#: Least mean log-likelihood ratio of a character pair, in nats.
MIN_RATIO = 0.5
#: Least sum of them, in nats: that of the shortest run at the least mean. It decides how short a piece can be.
MIN_SUM = 19 * MIN_RATIO
#: Ends a piece of a run.
SEPARATOR = "[/_=+-]"


def base_spans(text: Column) -> Column:
    assign = F.filter(S.find(text, ASSIGN, 0, text.rlike(r"(?i)passw|secret|token|api_?key"), group=2), lambda s: F.length(s["value"]) >= 8)
    access = F.filter(S.find(text, ACCESS, 1, text.contains("AKIA")), lambda s: s["end"] - s["start"] >= 16)
    hexes = S.find(text, HEX, 2, text.rlike(HEX))
    return F.array_sort(F.concat(assign, access, hexes))


def _characters(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))


def _pairs(value: Column) -> Column:
    """The character pairs of a string."""
    but_one = lambda c, first: F.slice(c, F.lit(first), F.greatest(F.size(c) - 1, F.lit(0)))
    return S.let(_characters(F.coalesce(value, F.lit(""))), lambda c: F.zip_with(but_one(c, 1), but_one(c, 2), lambda x, y: F.concat(x, y)))


def fit(random: DataFrame, ordinary: DataFrame) -> list[float]:
    """The log-likelihood ratio of each pair of the alphabet, row by row, from two tables of strings (column ``value``).

    Only counts by pair reach the driver: at most the alphabet's size squared for each model.
    """
    counts = []
    for sample in (random, ordinary):
        seen = sample.select(F.explode(_pairs(F.col("value"))).alias("pair")).where(F.col("pair").rlike(r"^[A-Za-z0-9+/_=-]{2}$")).groupBy("pair").agg(F.count("*").alias("n"))
        counts.append({r["pair"]: r["n"] for r in seen.collect()})
    singles = [{b: sum(c.get(a + b, 0) for a in ALPHABET) + SMOOTH for b in ALPHABET} for c in counts]
    rows = []
    for a in ALPHABET:
        after = [sum(c.get(a + b, 0) for b in ALPHABET) for c in counts]
        for b in ALPHABET:
            # a pair leans on the frequency of its second character, the more so the rarer its first one
            p, q = ((c.get(a + b, 0) + BACKOFF * one[b] / sum(one.values())) / (n + BACKOFF) for c, one, n in zip(counts, singles, after, strict=True))
            rows.append(math.log(p / q))
    return rows


def _score(value: Column, ratios: Column) -> Column:
    """(sum, n) of the ratios of a string's pairs: one walk over its characters, whatever its length."""
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"))

    def step(acc: Column, c: Column) -> Column:
        place = F.instr(F.lit(ALPHABET), c) - 1
        counts = (acc["last"] >= 0) & (place >= 0)
        ratio = F.get(ratios, acc["last"] * len(ALPHABET) + place)
        return F.struct(place.alias("last"), (acc["sum"] + F.when(counts, ratio).otherwise(0.0)).alias("sum"), (acc["n"] + F.when(counts, 1).otherwise(0)).alias("n"))

    return F.aggregate(_characters(value), start, step, lambda acc: F.struct(acc["sum"].alias("sum"), acc["n"].alias("n")))


def _cut(run: Column, base: Column) -> Column:
    """What the base spans leave of a run, as spans."""
    inner = F.filter(base, lambda s: (s["start"] < run["end"]) & (run["start"] < s["end"]))
    part = lambda start, end: F.struct(start.alias("start"), run["kind"].alias("kind"), end.alias("end"), F.substring(run["value"], (start - run["start"] + 1).cast("int"), (end - start).cast("int")).alias("value")).cast(S.SPAN)
    first = F.struct(run["start"].alias("at"), S.no_spans().alias("out"))

    def add(acc: Column, s: Column) -> Column:
        out = F.when(s["start"] > acc["at"], F.concat(acc["out"], F.array(part(acc["at"], s["start"])))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    end = lambda acc: F.when(acc["at"] < run["end"], F.concat(acc["out"], F.array(part(acc["at"], run["end"])))).otherwise(acc["out"])
    return F.aggregate(inner, first, add, end)


_STRETCH = "struct<sum:double,n:int,lo:bigint,hi:bigint>"


def _stretches(pieces: Column, min_ratio: float, enough) -> Column:
    """The stretches of good pieces with no bad one between, if there is enough of them. A piece of one character has no
    pair and breaks no stretch."""
    none, nothing = F.lit(None).cast(_STRETCH), F.array().cast(f"array<{_STRETCH}>")
    flushed = lambda acc: F.when(enough(acc["open"]), F.array_append(acc["out"], acc["open"])).otherwise(acc["out"])

    def step(acc: Column, p: Column) -> Column:
        joined = F.struct((F.coalesce(acc["open"]["sum"], F.lit(0.0)) + p["score"]["sum"]).alias("sum"), (F.coalesce(acc["open"]["n"], F.lit(0)) + p["score"]["n"]).alias("n"), F.coalesce(acc["open"]["lo"], p["start"]).alias("lo"), p["end"].alias("hi")).cast(_STRETCH)
        bad = p["score"]["sum"] < min_ratio * p["score"]["n"]
        return F.struct(F.when(bad, none).when(p["score"]["n"] == 0, acc["open"]).otherwise(joined).alias("open"), F.when(bad, flushed(acc)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pieces, F.struct(none.alias("open"), nothing.alias("out")), step, flushed)


def random_spans(runs: Column, ratios: Column, min_ratio: float = MIN_RATIO, min_sum: float = MIN_SUM) -> Column:
    """Of an array of runs, those that look random; of the others, the stretches of their pieces that do."""
    enough = lambda s: F.coalesce((s["sum"] >= min_sum) & (s["sum"] >= min_ratio * s["n"]), F.lit(False))
    cut = lambda value: F.filter(S.find(value, f"[^{SEPARATOR[1:]}+", 3, F.lit(True)), lambda s: s["end"] > s["start"])
    scored = lambda value: F.transform(cut(value), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), _score(p["value"], ratios).alias("score")))
    part = lambda run, s: F.struct((run["start"] + s["lo"]).alias("start"), run["kind"].alias("kind"), (run["start"] + s["hi"]).alias("end"), F.substring(run["value"], (s["lo"] + 1).cast("int"), (s["hi"] - s["lo"]).cast("int")).alias("value")).cast(S.SPAN)
    parts = lambda run: F.transform(_stretches(scored(run["value"]), min_ratio, enough), lambda s: part(run, s))
    return F.flatten(F.transform(runs, lambda run: F.when(enough(_score(run["value"], ratios)), F.array(run)).otherwise(parts(run))))


def scan(docs: DataFrame, train_docs: int = TRAIN_DOCS, min_ratio: float = MIN_RATIO) -> DataFrame:
    """Per document row: doc_id, digest (of the text), base and spans (sorted arrays of spans).

    A null or empty text has no spans. Equal rows stay apart; other columns are ignored. Without any random or ordinary
    sample the models are uniform and add nothing.
    """
    text = F.col("text")
    long_runs = S.find(text, RUN, 3, text.rlike(RUN))
    found = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("sample"), F.unhex(F.sha2("text", 256)).alias("digest"), base_spans(text).alias("base"), long_runs.alias("runs"))
    found = stage(found.withColumn("runs", F.flatten(F.transform("runs", lambda r: _cut(r, F.col("base"))))), "secrets")

    total = found.agg(F.count("*")).first()[0]
    chosen = F.pmod(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(17)), F.lit(max(1, total // train_docs))) == 0
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    ordinary = docs.where(chosen).select(F.explode(F.regexp_extract_all(bare, F.lit(SHORT), F.lit(0))).alias("value"))
    random = found.select(F.explode("base").alias("s")).select(F.col("s.value").alias("value"))
    ratios = F.from_json(F.lit(json.dumps(fit(random, ordinary))), "array<double>")
    return found.select("doc_id", "digest", "base", F.when(F.size("runs") > 0, F.array_sort(F.concat("base", random_spans(F.col("runs"), ratios, min_ratio)))).otherwise(F.col("base")).alias("spans"))


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """Documents with each secret replaced by ``mask`` in the text and ``n_chars`` set anew; rows and columns stay."""
    columns = docs.columns
    text = F.col("row.text")
    named = docs.select(F.struct(*[docs[c] for c in columns]).alias("row"))
    suspect = F.coalesce(text.rlike(RUN) | text.contains("AKIA") | text.rlike(r"(?i)passw|secret|token|api_?key"), F.lit(False))
    spans = scan(docs).where(F.size("spans") > 0).select("digest", "spans").dropDuplicates(["digest"])
    # Only texts that can hold a secret are shuffled to meet their spans.
    hit = named.where(suspect).withColumn("digest", F.unhex(F.sha2(text, 256))).join(spans, "digest", "left")
    new_text = S.masked(text, F.coalesce("spans", S.no_spans()), mask)
    row = F.col("row").withField("text", new_text)
    if "n_chars" in columns:
        row = row.withField("n_chars", F.length(new_text).cast("long"))
    changed = hit.select(F.when(F.col("spans").isNotNull(), row).otherwise(F.col("row")).alias("row"))
    return named.where(~suspect).unionByName(changed).select("row.*")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base, every = F.col("base"), F.col("spans")
    counts = [S.count_kind(base, k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(S.written(base, KINDS), 256).alias("base_sha256"), S.written(every, KINDS).alias("spans"))
