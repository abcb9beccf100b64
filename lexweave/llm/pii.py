"""Personal data: fixed patterns, and terms that reveal the people behind them.

Information-theoretic sanitisation: an e-mail address, card, phone number or IP address that the patterns find is a
protected entity. How strongly a term t reveals an entity c is their pointwise mutual information over the corpus,
compared with the entity's own information: PMI(c, t) / -log p(c). At 1 the term occurs with this entity only. Terms at
``threshold`` or above are spans of kind ``term`` wherever they stand, also in documents without the entity. All counts
are of different texts, so that copies of one document are one witness. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import spans as S
from lexweave.llm.common import stage, table

KINDS = ("email", "ip", "card", "phone", "term")
# Possessive runs and look-behinds change no match: a run can only match from its first character or from the end of
# the match before it, and nothing after a run begins with a character of the run. They keep long texts linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Chains of 12 to 19 digits only: others fail the rule whatever they hold.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"[\p{L}\p{N}]{2,}+"
#: Fewest texts with an entity, and with an entity and a term, from which anything is concluded.
SUPPORT = 3
THRESHOLD = 0.9


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.filter(F.split(F.regexp_replace(value, "[^0-9]", ""), ""), lambda c: c != ""))
    each = F.transform(digits, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def base_spans(text: Column) -> Column:
    small = lambda part: (F.length(F.regexp_replace(part, "^0+", "")) <= 3) & (F.coalesce(F.substring(F.regexp_replace(part, "^0+", ""), 1, 3).try_cast("int"), F.lit(0)) <= 255)
    email = S.find(text, EMAIL, 0, text.contains("@"))
    ip = F.filter(S.find(text, IP, 1, text.rlike(IP)), lambda s: F.forall(F.split(s["value"], r"\."), small))
    card = F.filter(S.find(text, CARD, 2, text.rlike(CARD)), lambda s: _luhn(s["value"]))
    phone = F.filter(S.find(text, PHONE, 3, text.contains("+")), lambda s: F.length(F.regexp_replace(s["value"], "[^0-9]", "")).between(9, 15))
    return F.array_sort(F.concat(email, ip, card, phone))


def disclosing_terms(docs: DataFrame, held: DataFrame, repeated: DataFrame, total: int, support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """From (digest, entity) of all texts: (digest, term) of every text that holds a term to mask.

    ``total`` is the number of different texts, ``repeated`` the digests of those with copies, and all counts are of
    different texts. Only entities in ``support`` texts matter, so terms come from their texts alone; how often a term
    occurs is counted over the whole corpus. A text without copies adds to sums within its task; only for the others do
    their terms move, so that copies count once.
    """
    known = held.groupBy("entity").agg(F.count("*").alias("n_c")).where(F.col("n_c") >= support)
    held = stage(held.join(known, "entity"), "entities")
    texts = docs.where(F.col("text").isNotNull()).select(F.unhex(F.sha2(F.col("text").cast("string"), 256)).alias("digest"), F.col("text").cast("string").alias("text"))
    own = S.maybe_in(texts, "digest", held.select("digest")).join(held.select("digest").distinct(), "digest").dropDuplicates(["digest"])
    words = lambda df: df.select("digest", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.lower))).alias("term"))
    log = lambda c: F.log(F.greatest(c, F.lit(1.0001)))
    n = F.lit(float(max(total, 2)))
    ratio = lambda n_t: F.log(n * F.col("n_ct") / (F.col("n_c") * F.greatest(n_t, "n_ct"))) / log(n / F.col("n_c"))
    own_words = stage(words(own), "own-words")
    pairs = own_words.join(held, "digest").groupBy("entity", "term").agg(F.count("*").alias("n_ct"), F.first("n_c").alias("n_c")).where(F.col("n_ct") >= support)
    # A term too common in these documents alone is too common in the corpus: it needs no count there.
    within = own_words.groupBy("term").agg(F.count("*").alias("n_own"))
    pairs = stage(pairs.join(within, "term").where(ratio(F.col("n_own")) >= threshold).drop("n_own"), "pairs")
    sums = lambda df: df.groupBy("term").agg(F.count("*").alias("n_t"))
    each = S.maybe_marked(texts, "digest", repeated, "copied")
    once = sums(S.maybe_in(words(each.where("NOT copied")), "term", pairs.select("term")))
    copied = sums(S.maybe_in(words(each.where("copied")), "term", pairs.select("term")).distinct())
    counted = once.unionByName(copied).groupBy("term").agg(F.sum("n_t").alias("n_t"))
    telling = stage(pairs.join(counted, "term").where(ratio(F.col("n_t")) >= threshold).select("term").distinct(), "telling")
    # An inner join: a semi join would be moved before the bitmap, and all words of the corpus shuffled.
    return S.maybe_in(words(texts), "term", telling).join(telling, "term").select("digest", "term").distinct()


def scan(docs: DataFrame, support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """Per document row: doc_id, digest (of the text), base and spans (sorted arrays of spans).

    A null or empty text has no spans. Equal rows stay apart, and are one witness; other columns are ignored.
    """
    text = F.col("text")
    found = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), base_spans(text).alias("base"))
    found = stage(found, "pii")
    # A text is one witness, however often it stands in the corpus and however often it names the entity.
    held = found.where(F.size("base") > 0).select("digest", F.explode("base").alias("e")).select("digest", F.concat_ws(":", "e.kind", "e.value").alias("entity")).distinct()
    copies = stage(found.groupBy("digest").agg(F.count("*").alias("n")).groupBy((F.col("n") > 1).alias("many"), F.when(F.col("n") > 1, F.col("digest")).alias("digest")).agg(F.count("*").alias("texts")), "copies")
    total = copies.agg(F.sum("texts")).first()[0] or 0
    terms = stage(disclosing_terms(docs, held, copies.where("many").select("digest"), total, support, threshold), "terms")

    texts = docs.where(F.col("text").isNotNull()).select(F.unhex(F.sha2(F.col("text").cast("string"), 256)).alias("digest"), F.col("text").cast("string").alias("text"))
    listed = terms.groupBy("digest").agg(F.collect_set("term").alias("telling"))
    marked_texts = S.maybe_in(texts, "digest", terms.select("digest")).dropDuplicates(["digest"]).join(listed, "digest")
    words = S.find(F.col("text"), TERM, KINDS.index("term"), F.lit(True))
    marked = marked_texts.select("digest", F.filter(words, lambda s: F.array_contains("telling", F.lower(s["value"]))).alias("terms"))
    clear = lambda base: lambda r: ~F.exists(base, lambda s: (s["start"] < r["end"]) & (r["start"] < s["end"]))
    joined = found.join(marked, "digest", "left")
    return joined.select("doc_id", "digest", "base", F.array_sort(F.concat("base", F.filter(F.coalesce("terms", S.no_spans()), clear(F.col("base"))))).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """Documents with personal data and telling terms replaced by ``[PRIVATE]``; rows and columns stay."""
    columns = docs.columns
    named = docs.select(F.struct(*[docs[c] for c in columns]).alias("row"))
    spans = scan(docs).where(F.size("spans") > 0).select("digest", "spans").dropDuplicates(["digest"])
    joined = named.withColumn("digest", F.unhex(F.sha2(F.coalesce("row.text", F.lit("")), 256))).join(spans, "digest", "left")
    return joined.select(F.col("row").withField("text", S.masked(F.col("row.text"), F.coalesce("spans", S.no_spans()), "[PRIVATE]")).alias("row")).select("row.*")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base, every = F.col("base"), F.col("spans")
    counts = [S.count_kind(base, k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(S.written(base, KINDS), 256).alias("base_sha256"), S.written(every, KINDS).alias("spans"))
