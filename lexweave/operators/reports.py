"""Report rows and their formats: CSV cells, nested JSON, labels, notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMULA = r"^(?:[\s\x00-\x1f﻿]*[=+\-@]|[\t\r\n])"


def guarded_cell(value: Column) -> Column:
    """A cell that a spreadsheet would take for a formula gets an apostrophe in front."""
    return F.when(value.rlike(FORMULA), F.concat(F.lit("'"), value)).otherwise(value)


def write_csv(rows: DataFrame, path: str) -> None:
    """Semicolons, all cells quoted and guarded; one part for each task."""
    cells = [guarded_cell(F.col(c).cast("string")).alias(c) for c in rows.columns]
    rows.select(*cells).write.option("sep", ";").option("quoteAll", True).option("header", True).option("encoding", "UTF-8").mode("overwrite").csv(path)


def nested_json(findings: DataFrame, document: str, columns: list[str], order: list[str]) -> DataFrame:
    """(document, json): a document's findings in order as one JSON object."""
    keys = [F.col(c).alias(f"_{i}") for i, c in enumerate(order)]
    rows = F.array_sort(F.collect_list(F.struct(*keys, F.struct(*columns).alias("item"))))
    grouped = findings.groupBy(document).agg(rows.alias("rows"))
    return grouped.select(document, F.to_json(F.struct(F.col(document), F.transform("rows", lambda r: r["item"]).alias("findings"))).alias("json"))


def slug(name: Column) -> Column:
    return F.left(F.btrim(F.regexp_replace(name, r"(?U)[^\w]+", "_"), F.lit("_")), F.lit(80))


def location(clause: Column, page: Column) -> Column:
    named = F.when(clause.rlike(r"^\d"), F.concat(F.lit("п. "), clause)).otherwise(F.when(clause != "", clause))
    text = F.concat_ws(", ", named, F.concat(F.lit("стр. "), page))
    return F.when(text == "", "—").otherwise(text)


def comment_parts(comment: Column) -> Column:
    """A merged comment as parts: plain text, and the notes of merged risks with their label."""
    parts = F.filter(F.split(comment, r"\n\s*\n"), lambda p: F.btrim(p) != "")
    note = r"(?s)^\[Дополнительный риск: (.*?)\]\s*(.*)$"
    return F.transform(parts, lambda p: F.struct(F.when(p.rlike(note), F.regexp_extract(p, note, 1)).alias("label"), F.when(p.rlike(note), F.regexp_extract(p, note, 2)).otherwise(F.btrim(p)).alias("text")))


def highlighted(text: Column, needle: str) -> Column:
    """The text cut at each occurrence of a needle in any case: pieces with a flag."""
    quoted = "(?iu)" + "\\Q" + needle.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    gaps, hits = F.split(text, quoted, -1), F.regexp_extract_all(text, F.lit(quoted), F.lit(0))
    pairs = F.zip_with(gaps, hits, lambda g, h: F.array(F.struct(g.alias("text"), F.lit(False).alias("hit")), F.struct(h.alias("text"), F.lit(True).alias("hit"))))
    return F.filter(F.flatten(pairs), lambda p: F.coalesce(p["text"], F.lit("")) != "")


def assessment(documents: DataFrame, by: str, *more: Column) -> DataFrame:
    """Report head: the score if every document was assessed, unknown light unless all are completed and checked. ``more``
    are further aggregates of the same pass."""
    assessed = (F.col("status") == "COMPLETED") & (F.col("rules_checked") > 0)
    rolled = documents.groupBy(by).agg(
        F.count("*").alias("documents"),
        F.count_if(~assessed).alias("open"),
        F.max("score").alias("top"),
        F.count_if(assessed & F.col("score").isNull()).alias("unscored"),
        *[F.sum(c).alias(c) for c in ("critical", "warning", "low", "unknown", "rules_checked")],
        *more,
    )
    light = F.when(F.col("critical") > 0, "RED").when(F.col("warning") > 0, "YELLOW").when((F.col("unknown") > 0) | (F.col("open") > 0), "UNKNOWN").otherwise("GREEN")
    light = F.when(F.col("open") > 0, "UNKNOWN").otherwise(light)
    return rolled.withColumn("score", F.when((F.col("open") == 0) & (F.col("unscored") == 0), F.col("top"))).withColumn("light", light).drop("top", "unscored")


def heuristic_note(findings: DataFrame, by: str) -> DataFrame:
    """(by, note, numbers): whether all or some findings come from keywords, and which."""
    own = F.col("source") == "HEURISTIC"
    grouped = findings.groupBy(by).agg(F.count("*").alias("n"), F.count_if(own).alias("k"), F.array_sort(F.collect_list(F.when(own, F.col("number")))).alias("numbers"))
    return grouped.select(by, F.when(F.col("k") == 0, None).when(F.col("k") == F.col("n"), "all").otherwise("some").alias("note"), "numbers")


def annotated_allowed(documents: DataFrame, by: str) -> DataFrame:
    """(by, allowed): exactly one document, and no unknown finding that is not dismissed."""
    return documents.groupBy(by).agg(((F.count("*") == 1) & (F.sum("unknown") == 0)).alias("allowed"))


#: Fixed: suffixes of archives, and what a report calls its source.
ARCHIVES = (".zip", ".tar", ".gz", ".7z", ".rar")
SOURCE_ARCHIVE, SOURCE_FILE = "Исходный архив", "Исходный файл"


def source_label(upload: Column, n_documents: Column) -> Column:
    """How a report of a whole upload names it: an archive by its suffix or by holding several documents."""
    packed = F.lower(upload).rlike("(?:" + "|".join(a.replace(".", r"\.") for a in ARCHIVES) + ")$")
    return F.when(F.coalesce(packed, F.lit(False)) | (n_documents > 1), SOURCE_ARCHIVE).otherwise(SOURCE_FILE)


def from_archive(upload: Column, file_name: Column, path: Column) -> Column:
    """Whether a document's report names the upload too: an archive, or a document with a name or path of its own."""
    packed = F.lower(upload).rlike("(?:" + "|".join(a.replace(".", r"\.") for a in ARCHIVES) + ")$")
    elsewhere = (F.coalesce(path, F.lit("")) != "") & (path != upload)
    return F.coalesce(packed, F.lit(False)) | F.coalesce(elsewhere, F.lit(False)) | ~file_name.eqNullSafe(upload)
