"""Keyword evaluation of rules over retrieved chunks, and the guards on what it finds.

Rules are rows: rule, severity, title, description, query, prompt, and the optional patterns marker, exception and
guard. Patterns are columns, so a rule set of any size is one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.operators.columns import let
from lexweave.operators.retrieval import stems

SENSITIVITIES = ("strict", "balanced", "sensitive")
RANK = {"RED": 3, "YELLOW": 2, "LOW": 1, "GREEN": 0}

# Markers of critical terms, their exceptions, and the words that a rule's subject needs.
NUMBER_WORDS = r"\s*(?:\([^)]*\)\s*)?"
DAYS = r"(?:рабоч\w*\s+|календарн\w*\s+)?(?:дн[еяйи]\w*|день)\b"
PERCENT = r"(?:[.,]\d+)?\s*(?:\([^)]*\)\s*)?(?:%|процент)"
SHORT_TERM = rf"(?:в\s+течение|по\s+истечении|через)\s+[1-5]{NUMBER_WORDS}{DAYS}"
MARKERS = {
    "rnp_short_cure_period": rf"односторонн\w*\s+отказ[^.]{{0,250}}{SHORT_TERM}|{SHORT_TERM}[^.]{{0,250}}односторонн\w*\s+отказ|односторонн\w*\s+отказ[^.]{{0,250}}вступа\w*\s+в\s+силу\s+(?:со\s+дня|с\s+момента|с\s+даты)\s+(?:его\s+)?(?:направлен|размещен|получен)",
    "short_delivery_time": rf"(?:поставк\w*|передач\w*\s+товар)[^.]{{0,120}}(?:в\s+течение|составляет)\s+[1-5]{NUMBER_WORDS}{DAYS}|(?:в\s+течение|составляет)\s+[1-5]{NUMBER_WORDS}{DAYS}[^.]{{0,120}}(?:поставк\w*|передач\w*\s+товар)",
    "defect_fix_deadline": rf"\b24{NUMBER_WORDS}час|\b[1-3]{NUMBER_WORDS}{DAYS}|\bсут(?:ок|ки)\b|незамедлительн\w*\s+(?:устран|замен)",
    "unconditional_bg_claim": r"безакцепт\w*|бесспорн\w*|(?:100\s*%|ста\s+процентов|вс\w+\s+сумм\w*|полн\w*\s+сумм\w*)[^.]{0,80}(?:гаранти|обеспечени)|(?:гаранти|обеспечени)\w*[^.]{0,80}(?:100\s*%|ста\s+процентов|вс\w+\s+сумм\w*|полн\w*\s+сумм\w*)",
    "uncapped_liability": r"не\s+ограничива\w*\s+(?:ценой|суммой|размером)|сверх\s+(?:суммы\s+)?неустойк|без\s+ограничени\w*\s+(?:размер|сумм|ответственност)|в\s+полном\s+объ[её]ме\s+сверх",
    "brand_without_equivalent": r"эквивалент\w*\s+не\s+допуска|не\s+допуска\w*\s+(?:поставк\w*\s+)?эквивалент|без\s+(?:права\s+)?(?:замены|эквивалент)|\b(?:hewlett|hp|cisco|oracle|dell|lenovo)\b|гарантийн\w*\s+письм\w*\s+производител|авторизацион\w*\s+письм",
    "experience_restricted_44_223": r"исключительно\s+[^.]{0,160}(?:44-фз|223-фз|государственн|реестр\w*\s+контракт)",
    "unreasonable_penalty": rf"(?:фиксированн\w*\s+размер\w*|штраф\w*\s+в\s+размере)\s+(?:[5-9]|[1-9]\d{{1,2}})(?!\d){PERCENT}",
}
EXCEPTIONS = {"brand_without_equivalent": r"или\s+эквивалент|эквивалент\w*\s+допуска"}
GUARDS = {
    "ip_rights_transfer": r"(?:исключительн\w*\s+прав|интеллектуальн\w*|авторск\w*\s+прав|патент\w*|ноу-хау)",
    "subcontracting_terms": r"(?:субподряд\w*|соисполнител\w*|привлечен\w*\s+третьих|смп|сонко)",
    "national_regime": r"(?:национальн\w*\s+режим|\b(?:616|617|878|1875)\b|реестр\w*\s+российск|евразийск|происхожден\w*\s+товар)",
    "bid_security_excessive": r"(?:обеспечени\w*\s+(?:заявк|подач\w*\s+заяв)|размер\w*\s+обеспечения\s+заявк)",
    "contract_security_excessive": rf"обеспечени\w*[^.]{{0,80}}?\b(?:1[5-9]|[2-9]\d)(?!\d){PERCENT}|превышает\s+30\s*%",
    "trademark_no_equivalent": r"(?:товарн\w*\s+знак|знак\w*\s+обслуживан|фирменн\w*\s+наименован|модел\w*|производител)",
}
# Texts that deny the risk they are attached to.
CONTRADICTIONS = (
    r"нарушени[яйее]\s+(не\s+выявлен|отсутствуют|нет)",
    r"риск[а-я]*\s+(не\s+выявлен|отсутствуют|нет|не\s+установлен)",
    r"(условие|пункт|положение)\s+(соответствует|стандартно|законно)",
    r"соответствует\s+(требованиям\s+)?(44-фз|223-фз|гк\s*рф|законодательств)",
)
TITLE_ONLY = r"(?iU)^(раздел|статья|приложение|глава|пункт|п\.|ст\.)\s*\d+[\.\d\s\w\(\)]*$"
LEAST_CONFIDENCE = 0.25


def pattern_table(spark: SparkSession) -> DataFrame:
    """(rule, marker, exception, guard) of the rules that have any; patterns ignore case and know all letters."""
    flag = lambda p: None if p is None else f"(?iU){p}"
    rows = [(k, flag(MARKERS.get(k)), flag(EXCEPTIONS.get(k)), flag(GUARDS.get(k))) for k in sorted(MARKERS.keys() | GUARDS.keys())]
    return spark.createDataFrame(rows, "rule string, marker string, exception string, guard string")


def marked_rules(text: Column) -> Column:
    """The ids of the fixed rules whose marker stands in a text that no exception covers, sorted. The patterns are
    literals, so each is compiled once."""
    has = lambda pattern: text.rlike(f"(?iU){pattern}")
    covered = lambda rule: has(EXCEPTIONS[rule]) if rule in EXCEPTIONS else F.lit(False)
    return F.array_compact(F.array(*[F.when(has(MARKERS[rule]) & ~covered(rule), rule) for rule in sorted(MARKERS)]))


def allowed_rules(text: Column) -> Column:
    """The ids of the fixed rules with a guard that a text passes, sorted."""
    return F.array_compact(F.array(*[F.when(text.rlike(f"(?iU){GUARDS[rule]}"), rule) for rule in sorted(GUARDS)]))


def weaker(a: Column, b: Column) -> Column:
    """The lesser of two severities; unknown ones rank lowest, and the first wins a tie."""
    rank = lambda c: F.coalesce(*[F.when(c == s, F.lit(r)) for s, r in RANK.items()], F.lit(0))
    return F.when(rank(a) <= rank(b), a).otherwise(b)


def is_noise(sentence: Column) -> Column:
    """Fewer than 55 letters in 100 characters other than white space, or none at all."""
    solid = F.regexp_count(sentence, F.lit(r"(?U)\S"))
    letters = F.regexp_count(sentence, F.lit(r"\p{L}"))
    return (solid == 0) | (100 * letters < 55 * solid)  # whole numbers, as 0.55 * 20 is more than 11


def is_heading_quote(quote: Column) -> Column:
    """Too short, a bare title, short capitals, a label without content, or numbers only."""
    return let(F.btrim(F.regexp_replace(F.coalesce(quote, F.lit("")), r"(?U)^\s+|\s+$", "")), _is_heading)


def _is_heading(text: Column) -> Column:
    capitals = (F.regexp_count(text, F.lit(r"\p{L}")) > 0) & (F.regexp_count(text, F.lit(r"\p{L}")) == F.regexp_count(text, F.lit(r"\p{Lu}")))
    return (F.length(text) < 15) | text.rlike(TITLE_ONLY) | ((F.length(text) < 90) & capitals) | text.rlike(r"(?U)^[\w\s]{1,30}:\s*(\d+(\.\d+)*\.?)?$") | text.rlike(r"(?U)^[\d\.\s\(\)\-]+$")


def contradicts_itself(comment: Column, summary: Column) -> Column:
    text = F.concat_ws(" ", F.coalesce(summary, F.lit("")), F.coalesce(comment, F.lit("")))
    return text.rlike("(?iu)" + "|".join(CONTRADICTIONS))


def sentences(content: Column) -> Column:
    """Sentences of over 20 characters, or the whole content; without headings and noise if anything is left then."""
    parts = F.filter(F.split(F.replace(content, F.lit("\n"), F.lit(" ")), r"(?U)(?<=[.;!?])\s+"), lambda s: F.length(F.btrim(s)) > 20)
    some = lambda found, other: let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(other))
    return let(some(parts, F.array(content)), lambda long: some(F.filter(long, lambda s: ~is_heading_quote(s) & ~is_noise(s)), long))


def recommendation(prompt: Column) -> Column:
    found = F.btrim(F.regexp_extract(prompt, r"(?iu)Рекомендация:\s*([^\n]+)", 1))
    return F.when(found != "", found)


def keyword_findings(contexts: DataFrame, rules: DataFrame, sensitivity: str = "balanced") -> DataFrame:
    """(document, rule, chunk, severity, quote, confidence, comment, proposal): at most one finding for each document and rule.

    ``contexts`` has document, rule, chunk, content, score and fts_hit; a chunk of a document has one content, which is
    cut into sentences once, whatever the number of its rules. Sensitive takes every chunk with a score; strict
    asks for two shared stems. A rule with a guard looks only at chunks that the guard allows. A marked sentence of the
    best marked chunk wins, else the sentence of the best chunk that shares most stems with the query.
    """
    if sensitivity not in SENSITIVITIES:
        raise ValueError(f"sensitivity is one of {SENSITIVITIES}")
    joined = contexts.join(rules, "rule").withColumn("query_stems", stems(F.col("query")))
    taken = F.col("fts_hit") | (F.lit(sensitivity == "sensitive") & (F.col("score") > 0))
    if sensitivity == "strict":
        shared = F.size(F.array_intersect(stems(F.col("content")), F.col("query_stems")))
        taken = taken & (shared >= F.least(F.lit(2), F.size("query_stems")))
    relevant = joined.where(taken).withColumn("allowed", F.coalesce(F.col("guard").isNull() | F.expr("content rlike guard"), F.lit(False)))
    of_rule = Window.partitionBy("document", "rule")
    some = F.max(F.col("allowed")).over(of_rule)
    relevant = relevant.withColumn("some", some).where(F.col("allowed") | (~F.col("some") & F.lit(sensitivity == "sensitive")))

    told = contexts.dropDuplicates(["document", "chunk"]).select("document", "chunk", F.posexplode(sentences(F.col("content"))).alias("pos", "sentence"))
    told = told.withColumn("sentence_stems", stems(F.col("sentence")))
    each = relevant.withColumn("first", F.row_number().over(of_rule.orderBy(F.desc("score"), "chunk"))).drop("content").join(told, ["document", "chunk"])
    marked = F.coalesce(F.expr("sentence rlike marker") & ~F.coalesce(F.expr("sentence rlike exception"), F.lit(False)), F.lit(False))
    overlap = F.size(F.array_intersect("sentence_stems", "query_stems"))
    each = each.withColumn("marked", marked).where(F.col("marked") | (F.col("first") == 1)).withColumn("overlap", overlap)
    choice = Window.partitionBy("document", "rule").orderBy(F.desc("marked"), F.when(F.col("marked"), F.col("first")), F.when(F.col("marked"), F.col("pos")), F.desc("overlap"), "pos")
    best = each.withColumn("_n", F.row_number().over(choice)).where("_n = 1")
    red = F.col("marked") & (F.col("severity") == "RED")
    note = F.when(red, "Обнаружен критический маркер условия; рекомендуется сформировать протокол разногласий.").otherwise("Найдено по ключевым словам; требуется проверка фрагмента документа специалистом.")
    return best.select(
        "document", "rule", "chunk",
        F.when(red, "RED").otherwise(weaker(F.col("severity"), F.lit("YELLOW"))).alias("severity"),
        F.left("sentence", F.lit(400)).alias("quote"),
        F.when(red, 0.7).otherwise(0.35).alias("confidence"),
        F.concat_ws(". ", "description", note).alias("comment"),
        recommendation(F.col("prompt")).alias("proposal"),
    )


def guarded(findings: DataFrame) -> DataFrame:
    """Drops risks whose quote says nothing, whose text denies them, or that are hardly believed; others stay."""
    risk = F.col("severity").isin("RED", "YELLOW", "LOW")
    summary = F.col("summary") if "summary" in findings.columns else F.lit("")
    bad = is_heading_quote(F.col("quote")) | contradicts_itself(F.col("comment"), summary) | F.coalesce(F.col("confidence") < LEAST_CONFIDENCE, F.lit(False))
    return findings.where(~risk | ~bad)
