"""Findings from model answers: only what is quoted word for word from a known fragment becomes one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.operators.evaluate import weaker
from lexweave.operators.quotes import lexeme_line, verify_quotes

# Fixed: a quote is evidence from so many characters and words on; words of a default prompt.
LEAST_CHARS = 20
LEAST_WORDS = 3
PROMPT_START = "Проверь условие «"
PROMPT_END = " Риском является условие, которое ухудшает положение поставщика или нарушает 44-ФЗ / 223-ФЗ."


def embedding_text(title: Column, content: Column) -> Column:
    return F.concat_ws("\n", F.nullif(title, F.lit("")), content)


def default_query(title: Column, description: Column) -> Column:
    return F.btrim(F.concat(title, F.lit(". "), description), F.lit(" ."))


def default_prompt(title: Column, description: Column) -> Column:
    told = F.when(description != "", F.concat(F.lit(" "), F.rtrim(description, F.lit(".")), F.lit("."))).otherwise("")
    return F.concat(F.lit(PROMPT_START), title, F.lit("»."), told, F.lit(PROMPT_END))


def retold_rules(rules: DataFrame) -> DataFrame:
    """Rules (title, description, new_title, new_description, query, prompt, vector) after an edit: texts that were made
    from the old words are made from the new ones, others stay; a rule whose query changes loses its vector."""
    old, new = ("title", "description"), ("new_title", "new_description")
    follow = lambda c, make: F.when(F.col(c) == make(*map(F.col, old)), make(*map(F.col, new))).otherwise(F.col(c))
    edited = rules.select("*", follow("query", default_query).alias("_query"), follow("prompt", default_prompt).alias("_prompt"))
    vector = F.when(F.col("_query").eqNullSafe(F.col("query")), F.col("vector"))
    kept = [c for c in rules.columns if c not in (*old, *new, "query", "prompt", "vector")]
    return edited.select(*kept, *[F.col(n).alias(o) for o, n in zip(old, new, strict=True)], F.col("_query").alias("query"), F.col("_prompt").alias("prompt"), vector.alias("vector"))


def named_fragments(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """Claims with the chunk that ``fragment`` names: ``F3`` is the third of its document and rule; null for no such."""
    named = F.regexp_extract("fragment", r"^F([1-9][0-9]{0,8})$", 1).try_cast("int")
    return claims.withColumn("ordinal", named).join(chunks, ["document", "rule", "ordinal"], "left")


def drafts(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document, rule, place, severity, reason, quote, comment, quote_verified, confidence) from checked answers.

    ``answers``: document, rule, rule_severity, verdict, explanation, claims (an array of fragment, quote, severity,
    comment, confidence: issues of a RISK, evidence of an OK; null or a null verdict stands for an answer that is no
    valid one). ``chunks``: document, rule, ordinal, content, page_text. One answer for each document and rule.

    NOT_FOUND gives nothing. UNKNOWN, a broken answer and one without chunks give an UNKNOWN finding. An OK is GREEN, by
    its first quote, if all its quotes stand; else UNKNOWN for the first that does not. A RISK gives a finding for each
    quote that stands, no graver than its rule, a repeated quote once, and UNKNOWN for each that does not.
    """
    keys = ["document", "rule"]
    has = chunks.select(*keys).distinct().withColumn("_has", F.lit(True))
    asked = answers.join(has, keys, "left").where("verdict IS NULL OR verdict <> 'NOT_FOUND'")
    broken = F.col("verdict").isNull() | (F.col("verdict").isin("RISK", "OK") & ~(F.size("claims") > 0))
    alone = F.when(F.coalesce(broken, F.lit(True)), "broken").when(F.col("_has").isNull(), "no_chunks").when(F.col("verdict") == "UNKNOWN", "undecided")
    asked = asked.withColumn("reason", alone)
    none = lambda kind: F.lit(None).cast(kind)
    whole = asked.where("reason IS NOT NULL").select(*keys, F.lit(0).alias("place"), F.lit("UNKNOWN").alias("severity"), "reason", none("string").alias("quote"), F.when(F.col("reason") == "undecided", F.col("explanation")).alias("comment"), F.lit(False).alias("quote_verified"), none("double").alias("confidence"))

    each = asked.where("reason IS NULL").select(*keys, "rule_severity", "verdict", "explanation", F.posexplode("claims").alias("place", "c")).select(*keys, "rule_severity", "verdict", "explanation", "place", "c.*")
    claims = named_fragments(each.withColumnRenamed("severity", "claimed"), chunks.select(*keys, "ordinal", F.col("content").alias("fragment_text"), "page_text"))
    known = F.col("ordinal").isNotNull() & F.col("fragment_text").isNotNull()
    judged = verify_quotes(claims.withColumn("fragment", F.col("fragment_text")))
    says = (F.length(F.btrim("quote", F.lit(" \t\r\n"))) >= LEAST_CHARS) & (F.size(F.regexp_extract_all("quote", F.lit(r"\p{L}+"), F.lit(0))) >= LEAST_WORDS)
    stands = F.coalesce(F.col("verified") & says, F.lit(False))
    reason = F.when(~known, "no_fragment").when(~stands, "unverified")
    judged = judged.withColumn("stands", stands).withColumn("reason", reason).withColumn("key", lexeme_line(F.col("quote"), False))

    # an OK is one finding: its first failure, else its first quote
    answer = Window.partitionBy(*keys)
    failed = F.min(F.when(F.col("reason").isNotNull(), F.col("place"))).over(answer)
    fine = judged.where("verdict = 'OK'").withColumn("chosen", F.coalesce(failed, F.lit(0))).where("place = chosen")
    ok = fine.select(*keys, F.lit(0).alias("place"), F.when(F.col("reason").isNull(), "GREEN").otherwise("UNKNOWN").alias("severity"), "reason", F.when(F.col("stands"), F.col("quote")).alias("quote"), F.when(F.col("stands"), F.col("explanation")).alias("comment"), F.col("stands").alias("quote_verified"), none("double").alias("confidence"))

    nth = F.row_number().over(Window.partitionBy(*keys, "stands", F.when(F.col("stands"), F.col("key")).otherwise(F.col("place").cast("string"))).orderBy("place"))
    risks = judged.where("verdict = 'RISK'").withColumn("nth", nth).where("nth = 1")
    ceiling = weaker(F.col("rule_severity"), F.col("claimed"))
    graded = F.when(~F.col("stands"), "UNKNOWN").when(ceiling.isin("RED", "YELLOW", "LOW"), ceiling).otherwise("UNKNOWN")
    risks = risks.withColumn("severity", graded).withColumn("reason", F.when(F.col("stands") & (F.col("severity") == "UNKNOWN"), "no_severity").otherwise(F.col("reason")))
    good = F.col("severity") != "UNKNOWN"
    risk = risks.select(*keys, "place", "severity", "reason", F.when(good, F.col("quote")).alias("quote"), F.when(good, F.col("comment")).alias("comment"), good.alias("quote_verified"), F.when(good, F.bround("confidence", 2)).alias("confidence"))
    return whole.unionByName(ok).unionByName(risk)
