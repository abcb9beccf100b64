"""Quality rules by weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a document. Expectation-maximisation over the counts of the
distinct vote patterns of the whole corpus estimates how often each rule votes bad on good and on bad documents, and with
that the posterior probability of a good document, which replaces an all-must-pass filter: a rule that often errs costs
no document by itself. Labelled documents are anchors whose class is known; the class of all others is estimated.
Without labels, constraints keep a fault that one sharp rule alone sees from being taken for that rule's noise.
There are at most 3 ** len(RULES) patterns, so the driver's share of the work does not grow with the corpus.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import frame, map_rows, stage, table

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bang", "top_word", "n_echoes")
FALSE_ALARM = 0.002
MISSED = 0.75
#: Share of bad votes on bad and on good documents before any evidence, and the votes that this is worth.
PRIOR = (0.125, 0.02)
PRIOR_VOTES = 10.0
#: Share of bad votes of a sharp rule on its own kind of bad documents before any evidence.
OWN_FAULT = 0.9
#: Labelled documents that the belief in a pattern is worth.
BELIEF = 2.0
_UPPER = [chr(c) for c in [*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]]


def _vote(value: float, good: float, bad: float) -> int:
    """Good at or below ``good``, bad above ``bad``, abstains between."""
    return 1 if value <= good else -1 if value > bad else 0


#: (name, vote from a dict of the features, whether the rule is sharp); ratios are safe for documents without words. A
#: sharp rule is one that hardly ever votes bad on a good document; the others are hints, whose worth is left to the rounds.
RULES = (
    ("symbols", lambda f: _vote(f["n_symbols"] / max(1, f["word_chars"]), 0.02, 0.08), True),
    ("repeats", lambda f: _vote(f["n_repeat_words"] / max(1, f["n_words"]), 0.05, 0.20), True),
    ("lines", lambda f: 0 if f["n_lines"] < 3 else _vote(f["n_dup_lines"] / f["n_lines"], 0.20, 0.45), True),
    ("capitals", lambda f: _vote(f["n_upper"] / max(1, f["word_chars"]), 0.15, 0.40), True),
    ("shouting", lambda f: _vote(f["n_bang"] / max(1, f["n_words"]), 0.10, 0.50), True),
    ("dominant", lambda f: 0 if f["n_words"] < 30 else _vote(f["top_word"] / f["n_words"], 0.20, 0.35), True),
    ("word_size", lambda f: 0 if f["n_words"] < 10 else _vote(abs(f["word_chars"] / f["n_words"] - 6.5), 3.5, 8.0), True),
    ("length", lambda f: 1 if f["n_words"] >= 50 else 0 if f["n_words"] >= 10 else -1, True),
    ("echoes", lambda f: 0 if f["n_words"] < 10 else _vote(f["n_echoes"] / f["n_words"], 0.05, 0.15), False),
    ("short", lambda f: _vote(-f["n_words"], -60, -60), False),
    ("long_lines", lambda f: _vote(f["n_words"] / max(1, f["n_lines"]), 60, 60), False),
)


def repeated_words(words: list[bytes], n: int = 5) -> int:
    """Words inside an n-word window that occurs at least twice, every occurrence included; exact."""
    if len(words) <= n:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    key, size = ids[: len(ids) - n + 1].copy(), len(seen)
    for j in range(1, n):
        if size * len(seen) >= 1 << 62:  # rank the prefixes so that the packed key stays exact
            _, key = np.unique(key, return_inverse=True)
            size = int(key.max()) + 1
        key = key * len(seen) + ids[j : len(ids) - n + 1 + j]
        size *= len(seen)
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(np.isin(key, twice))
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def features(text: str | None) -> dict[str, int]:
    text = text or ""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, SPACE)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(words),
        "n_lines": len(lines),
        "n_upper": sum(map(text.count, _UPPER)),
        "n_bang": text.count("!"),
        "top_word": max(Counter(words).values(), default=0),
        "n_echoes": sum(map(eq, words, words[1:])),
    }


def votes(f: dict[str, int]) -> str:
    """One character a rule: + good, - bad, 0 abstains."""
    return "".join("-0+"[rule(f) + 1] for _, rule, _ in RULES)


def fit(patterns: dict[str, int], rounds: int = 100, smooth: float = 1.0) -> dict[str, float]:
    """Posterior probability of a good document for each vote pattern, from the patterns' counts alone.

    A rule sees one kind of fault only, so seven good votes must not outweigh one bad vote from the start: the first
    belief is that a document with a bad vote of a sharp rule is bad. Each round re-estimates the class shares and each
    rule's votes by class. Sharp rules have three constraints, without which the strongest correlation between rules
    takes over the classes: such a rule votes bad on at most ``FALSE_ALARM`` of the good documents, catches at least its
    share of the bad ones, and votes good on a bad document at least ``MISSED`` times as often as on a good one. The
    votes of the other rules are used as they are estimated.
    """
    names = sorted(patterns)
    if not names:
        return {}
    count = np.array([patterns[p] for p in names], float)
    vote = np.array([[" -0+".index(c) - 1 for c in p] for p in names])
    sharp = np.array([s for _, _, s in RULES])
    good = np.where((vote[:, sharp] == 0).any(1), 0.02, 0.98)
    for _ in range(rounds):
        share = np.clip((count * good).sum() / count.sum(), 0.05, 0.98)
        score = np.full(len(names), math.log(share / (1 - share)))
        for j in range(vote.shape[1]):
            by = np.array([[(count * w)[vote[:, j] == v].sum() + smooth for v in range(3)] for w in (1 - good, good)])
            on_bad, on_good = (x / x.sum() for x in by)
            if not sharp[j]:
                score += np.array([math.log(on_good[0] / on_bad[0]), 0.0, math.log(on_good[2] / on_bad[2])])[vote[:, j]]
                continue
            alarm = math.log(min(on_good[0], FALSE_ALARM) / max(on_bad[0], 1 / vote.shape[1]))
            llr = np.array([alarm, 0.0, math.log(on_good[2] / max(on_bad[2], MISSED * on_good[2], 1e-9))])
            llr[2] = max(llr[2], 0.0)
            score += llr[vote[:, j]]
        new = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return {p: float(round(g, 6)) for p, g in zip(names, good, strict=True)}


def fit_anchored(patterns: dict[str, int], labelled: dict[str, tuple[int, int]], rounds: int = 100) -> tuple[dict[str, float], dict[str, tuple[float, float]]]:
    """Posteriors by pattern as in ``fit``, and for each rule its share of bad votes on bad and on good documents.

    Bad documents are of several kinds, one for each sharp rule and one for whatever no sharp rule sees, as a document
    with one fault has good votes of all other rules. ``labelled`` has the bad and the good labelled documents of each
    pattern, which are among those of ``patterns``. Their class is known, but not the kind of a bad one. In each round all
    others get a class and a kind by the shares of votes so far, and all together give the next shares. The first ones
    say that a kind is what its rule votes bad on. An abstaining rule is no evidence.

    Votes are taken for independent within a kind, which good documents of an odd make (code, say) are not. So what the
    rounds believe of a pattern counts as much as ``BELIEF`` labelled documents, beside those that have this pattern.
    """
    names = sorted(patterns)
    if not names:
        return {}, {}
    vote = np.array([["-0+".index(c) for c in p] for p in names])
    is_bad, is_good = ((vote == v).astype(float) for v in (0, 2))
    known = np.array([labelled.get(p, (0, 0)) for p in names], float)
    open_count = np.maximum(np.array([patterns[p] for p in names], float) - known.sum(1), 0)
    sharp = [j for j, (_, _, s) in enumerate(RULES) if s]
    prior = np.full((len(sharp) + 2, len(RULES)), PRIOR[0])  # the good class first, then the kinds
    prior[0] = PRIOR[1]
    prior[range(1, len(sharp) + 1), sharp] = OWN_FAULT
    share, alarm, good = np.array([0.5, *[0.5 / (len(sharp) + 1)] * (len(sharp) + 1)]), prior, np.zeros(len(names))
    for _ in range(rounds):
        score = np.log(share) + is_bad @ np.log(alarm).T + is_good @ np.log(1 - alarm).T
        belief = np.exp(score - score.max(1, keepdims=True)) + 1e-300
        kinds = belief[:, 1:] / belief[:, 1:].sum(1, keepdims=True)
        belief /= belief.sum(1, keepdims=True)
        mass = open_count[:, None] * belief
        mass[:, 0] += known[:, 1]
        mass[:, 1:] += known[:, :1] * kinds
        share = (mass.sum(0) + 1) / (mass.sum() + mass.shape[1])
        bad, fine = mass.T @ is_bad, mass.T @ is_good
        alarm = (bad + PRIOR_VOTES * prior) / (bad + fine + PRIOR_VOTES)
        done, good = np.abs(belief[:, 0] - good).max() < 1e-9, belief[:, 0]
        if done:
            break
    on_bad = (bad[1:].sum(0) + PRIOR_VOTES * PRIOR[0]) / ((bad + fine)[1:].sum(0) + PRIOR_VOTES)
    shares = {rule: (float(on_bad[j]), float(alarm[0, j])) for j, (rule, _, _) in enumerate(RULES)}
    posterior = (known[:, 1] + BELIEF * good) / (known.sum(1) + BELIEF)
    return {p: float(round(g, 6)) for p, g in zip(names, posterior, strict=True)}, shares


def score(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Per document row: doc_id, digest (of the text), the features, votes, posterior, base_failed, kept.

    ``labels`` (doc_id, quality 0 or 1) anchor the rounds if they cover good and bad documents (``fit_anchored``), else
    the counts of patterns alone decide (``fit``); a doc_id with both labels has none. All labels count: only sums by
    pattern reach the driver.

    A null or empty text has no words and fails the base rule. Equal rows stay apart; other columns are ignored.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t) for t in b.column("text").to_pylist()]
            yield frame({"doc_id": (b.column("doc_id").to_pylist(), pa.int64()), "digest": (b.column("digest").to_pylist(), pa.binary())} | {c: ([r[c] for r in rows], pa.int64()) for c in FEATURES} | {"votes": ([votes(r) for r in rows], pa.string())})

    spark = docs.sparkSession
    text = F.col("text").cast("string")
    measured = stage(map_rows(docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("digest")), measure, "doc_id long, digest binary, " + ", ".join(f"{c} long" for c in FEATURES) + ", votes string"), "quality")
    seen = {r["votes"]: r["n"] for r in measured.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    known = {}
    if labels is not None:
        sure = labels.where("quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).where("lo = hi")
        counts = measured.join(sure, "doc_id").groupBy("votes").agg(F.sum((F.col("lo") == 0).cast("long")).alias("bad"), F.sum((F.col("lo") == 1).cast("long")).alias("good"))
        known = {r["votes"]: (r["bad"], r["good"]) for r in counts.collect()}
    both = all(sum(n[c] for n in known.values()) for c in (0, 1))
    fitted = spark.createDataFrame(list((fit_anchored(seen, known)[0] if both else fit(seen)).items()), "votes string, posterior double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measured.join(F.broadcast(fitted), "votes", "left").withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def keep_good(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Documents that ``score`` keeps, with their own columns. The text alone decides, whatever the doc_id."""
    columns = docs.columns
    named = docs.select(F.struct(*[docs[c] for c in columns]).alias("row"), F.unhex(F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256)).alias("digest"))
    good = score(docs, labels).where("kept").select("digest").distinct()
    return named.join(good, "digest", "left_semi").select("row.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(*base, "posterior", "votes")
