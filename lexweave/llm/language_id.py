"""Language identification by Bayesian fusion of evidence.

The posterior of a language is the product of four kinds of evidence: the likelihood of the text under byte-trigram
models, the language that the markup declares, the suffix of the address, and the prior of the host. How reliable a
declaration or a suffix is, is counted over the corpus with the text's own verdicts as soft labels, less the record's
own share. Host priors are smoothed hierarchically: a host's counts fall back on its domain's, these on its suffix's,
and these on the whole corpus. All counts are grouped aggregations.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lexweave.llm.common import frame, map_rows, stage, table
from lexweave.llm.html_extract import host_of, main_text, parse

BUCKETS = 1 << 14
#: Different labelled texts that train the trigram models, shared equally by the languages.
TRAIN_DOCS = 4_000
#: Texts of each language at least, if it has as many, however many languages there are.
MIN_TRAIN = 100
#: A text's log-likelihood counts as that of so many trigrams at most: trigrams are not independent.
EVIDENCE = 60.0
#: Records that each level of the hierarchy is worth to the level below.
STRENGTH = 5.0
SALTS = 32
RESULTS = ("host", "declared", "suffix", "lang", "posterior", "posteriors")


def trigrams(text: str | None) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased text with white space, digits and symbols folded to one space."""
    data = np.frombuffer((" " + (text or "").lower() + " ").encode(errors="replace"), np.uint8).astype(np.uint32)
    data = np.where((data < 97) | ((data > 122) & (data < 128)), 32, data)
    data = data[(data != 32) | np.concatenate(([True], data[:-1] != 32))]
    if len(data) < 3:
        return np.zeros(0, np.int64)
    key = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    return ((key * np.uint32(2654435761)) >> np.uint32(32 - 14)).astype(np.int64)


def train(labelled: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities by bucket, from rows (text, lang).

    Every language of a labelled row is one, however rare. Each trains on its first texts by hash: the share of
    ``train_docs`` that falls to it, ``MIN_TRAIN`` at least, or all if it has fewer. Copies of a text are one text.
    Each task returns one count vector for each language.
    """
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    share = max(MIN_TRAIN, train_docs // max(1, len(langs)))
    # Only hashes are ranked; the texts of the chosen ones follow.
    hashed = labelled.select("lang", F.xxhash64("text", F.lit(5)).alias("hash")).distinct()
    # First within parts of a language, so that the rank of a common one reads SALTS shares at most.
    ranked = hashed.withColumn("part", F.pmod("hash", F.lit(SALTS)))
    for keys in (["lang", "part"], ["lang"]):
        ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("hash"))).where(F.col("place") <= share)
    ranked = ranked.select("lang", "hash")
    sample = labelled.withColumn("hash", F.xxhash64("text", F.lit(5))).join(F.broadcast(ranked), ["lang", "hash"]).dropDuplicates(["lang", "hash"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                sums[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
        rows = [(lang, k, int(v[k])) for lang, v in sums.items() for k in np.flatnonzero(v).tolist()]
        yield frame({"lang": ([r[0] for r in rows], pa.string()), "bucket": ([r[1] for r in rows], pa.int32()), "n": ([r[2] for r in rows], pa.int64())})

    counted = map_rows(sample.select("lang", "text"), count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    index = {lang: k for k, lang in enumerate(langs)}
    weights = np.full((len(langs), BUCKETS), 0.5)
    for r in counted.collect():  # languages times buckets at most
        weights[index[r["lang"]], r["bucket"]] += r["n"]
    return langs, np.log(weights / weights.sum(1, keepdims=True))


def _text_log_likelihoods(records: DataFrame, langs: list[str], weights: np.ndarray, keep: list[str]) -> DataFrame:
    sent = records.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = []
            markup = b.column("html").to_pylist()
            for text, html in zip(b.column("text").to_pylist(), markup, strict=True):
                t = trigrams(text if text is not None or html is None else main_text(parse(html), set()))
                if len(t):
                    counts = np.bincount(t, minlength=BUCKETS)
                    own = sent.value @ counts
                    scores.append((own * min(1.0, EVIDENCE / len(t))).tolist())
                else:
                    scores.append([0.0] * len(langs))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(scores, pa.list_(pa.float64()))], [*keep, "text_score"])

    return map_rows(records.select(*keep, "text", "html"), score, records.select(*keep).schema.add("text_score", ArrayType(DoubleType())))


def _softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    weights = F.transform(scores, lambda s: F.exp(s - top))
    return F.transform(weights, lambda w: w / F.aggregate(weights, F.lit(0.0), lambda a, b: a + b))


def _sums(df: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    """Sums of the soft labels by keys, as one array."""
    return df.groupBy(*keys).agg(F.array(*[F.sum(F.col("soft")[i]) for i in range(n)]).alias(name))


def identify(records: DataFrame, langs: list[str], weights: np.ndarray) -> DataFrame:
    """Per record: its own columns less text, html and url, then host, declared, suffix, lang, posterior, posteriors.

    A record has text or html (the main text is taken from it), and may have a url and a host. Missing evidence (null
    or empty text, no declaration, no host) is neutral; with none at all the corpus decides. Ties go to the language
    that comes first. Without languages (an empty training table) lang and posterior are null. Repeated rows are
    records of their own. A record's own column with the name of a result gives way to it; other names cannot clash.
    """
    n = len(langs)
    known = F.array(*[F.lit(x) for x in langs]) if n else F.array().cast("array<string>")
    html_lang = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    host = F.coalesce(F.col("host"), host_of(F.col("url")))
    own = [F.col(f"`{c}`") for c in records.columns if c.lower() not in ("text", "html", "url", *RESULTS)]
    named = records.select(F.struct(*own or [F.lit(None).cast("string").alias("none")]).alias("own"), F.nullif(host, F.lit("")).alias("host"), F.nullif(html_lang, F.lit("")).alias("declared"), "text", "html")
    scored = _text_log_likelihoods(named, langs, weights, ["own", "host", "declared"])
    of_record = ["own.*"] if own else []
    labels = F.split("host", r"\.")
    # Equal evidence is summed once: hosts are salted, so that one that holds a third of all rows is no hot group.
    scored = scored.withColumn("suffix", F.when(F.size(labels) > 1, F.element_at(labels, -1))).withColumn("domain", F.when(F.size(labels) > 1, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(F.col("host")))
    scored = stage(scored.withColumn("soft", _softmax(F.col("text_score"))).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")), "language")
    if not n:
        return scored.select(*of_record, "host", "declared", "suffix", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"), F.array().cast("array<double>").alias("posteriors"))

    whole = scored.agg(*[F.sum(F.col("soft")[i]) for i in range(n)]).first()
    whole = [x or 0.0 for x in whole]
    base = [(x + 1.0) / (sum(whole) + n) for x in whole]
    by_host = _sums(scored.where("host IS NOT NULL"), ["host", "domain", "suffix"], n, "host_n")
    by_domain = by_host.groupBy("domain", "suffix").agg(F.array(*[F.sum(F.col("host_n")[i]) for i in range(n)]).alias("domain_n"))
    by_suffix = by_domain.groupBy("suffix").agg(F.array(*[F.sum(F.col("domain_n")[i]) for i in range(n)]).alias("suffix_n"))
    tree = by_host.join(by_domain.withColumnRenamed("suffix", "_s"), "domain").drop("_s").join(by_suffix, by_host["suffix"].eqNullSafe(by_suffix["suffix"])).select("host", "host_n", "domain_n", "suffix_n")
    tree = stage(tree.dropDuplicates(["host"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "hosts")
    # P(declared | language), with add-one smoothing over the declarations seen
    by_declared = _sums(scored.where("declared IS NOT NULL"), ["declared"], n, "declared_n")
    n_declared = by_declared.count()
    declared = by_declared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    totals = by_declared.agg(*[F.sum(F.col("declared_n")[i]) for i in range(n)]).first()
    totals = [x or 0.0 for x in totals]

    joined = scored.join(tree, ["host", "salt"], "left").join(declared, ["declared", "salt"], "left")
    prior = F.array(*[F.lit(x) for x in base])
    for level in ("suffix_n", "domain_n", "host_n"):  # each level leaves the record itself out
        others = F.zip_with(F.col(level), F.col("soft"), lambda a, s: F.greatest(a - s, F.lit(0.0)))
        size = F.aggregate(others, F.lit(0.0), lambda a, b: a + b)
        prior = F.when(F.col(level).isNull(), prior).otherwise(F.zip_with(others, prior, lambda a, p: (a + STRENGTH * p) / (size + STRENGTH)))
        joined = joined.withColumn("prior", prior)
        prior = F.col("prior")
    said = F.array(*[F.log((F.greatest(F.col("declared_n")[i] - F.col("soft")[i], F.lit(0.0)) + 0.1) / F.lit(totals[i] + 0.1 * (n_declared + 1))) for i in range(n)])
    fused = F.zip_with(F.col("text_score"), F.col("prior"), lambda t, p: t + F.log(p))
    fused = F.when(F.col("declared_n").isNull(), fused).otherwise(F.zip_with(fused, said, lambda a, b: a + b))
    joined = joined.withColumn("posteriors", _softmax(fused)).withColumn("posterior", F.array_max("posteriors"))
    lang = F.element_at(known, F.array_position("posteriors", F.col("posterior")).cast("int"))
    return joined.select(*of_record, "host", "declared", "suffix", lang.alias("lang"), "posterior", "posteriors")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (doc_id; the source stands for the host) and pages (page_id); the other id is null."""
    documents, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    langs, weights = train(documents.select("text", "lang"))
    none = lambda kind: F.lit(None).cast(kind)
    of_docs = documents.select(F.col("doc_id").cast("long"), none("long").alias("page_id"), "text", none("string").alias("html"), none("string").alias("url"), F.col("source").alias("host"))
    of_pages = pages.select(none("long").alias("doc_id"), F.col("page_id").cast("long"), none("string").alias("text"), "html", "url", none("string").alias("host"))
    found = identify(of_docs.unionByName(of_pages), langs, weights)
    return found.select("doc_id", "page_id", "host", "declared", "suffix", "lang", F.round("posterior", 6).alias("posterior"))
