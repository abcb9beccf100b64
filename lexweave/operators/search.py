"""Filters, paging and small projections over documents, files, rules and the audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.operators.findings import REVIEW_NAMES, SEVERITY_NAMES


def parse_choice(value: str | None, known: dict[str, str]) -> list[str] | None:
    """Keys for a comma-joined list of outside names; None for no filter; a ValueError for an unknown name."""
    names = [p.strip().lower() for p in (value or "").split(",") if p.strip()]
    outside = {}
    for k, v in known.items():
        outside.setdefault(v, []).append(k)
    unknown = [n for n in names if n not in outside]
    if unknown:
        raise ValueError(f"unknown values: {', '.join(unknown)}")
    return [k for n in names for k in outside[n]] or None


def severities(value: str | None) -> list[str] | None:
    return parse_choice(value, SEVERITY_NAMES)


def reviews(value: str | None) -> list[str] | None:
    return parse_choice(value, REVIEW_NAMES)


def matching(rows: DataFrame, needle: str, columns: list[str], escape: bool = False) -> DataFrame:
    """Rows where a column holds the needle in any case; ``%`` and ``_`` are wildcards unless escaped."""
    if escape:
        needle = needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    test = F.lit(False)
    for c in columns:
        test = test | F.coalesce(F.col(c).ilike(f"%{needle}%"), F.lit(False))
    return rows.where(test)


def parents_matching(parents: DataFrame, children: DataFrame, key: str, needle: str, title: str, name: str) -> DataFrame:
    """Parents whose title, or a child's name, holds the needle."""
    by_child = matching(children, needle, [name]).select(key).distinct().withColumn("_child", F.lit(True))
    joined = parents.join(by_child, key, "left")
    return joined.where(F.col(title).ilike(f"%{needle}%") | F.coalesce("_child", F.lit(False))).drop("_child")


def owned(rows: DataFrame, owner: str, user: object, admin: bool = False) -> DataFrame:
    return rows if admin else rows.where(F.col(owner).isNull() | (F.col(owner) == F.lit(user)))


def owned_through(children: DataFrame, parents: DataFrame, key: str, owner: str, user: object, admin: bool = False) -> DataFrame:
    """Children whose parent the user owns; a child without a parent is no one's."""
    return children.join(owned(parents, owner, user, admin).select(key), key, "left_semi")


def uploads_matching(rows: DataFrame, needle: str | None, status: str | None, columns: list[str], state: str) -> DataFrame:
    """Rows of which a column holds the needle and whose state is the one asked for, written in any case; both optional."""
    found = matching(rows, needle, columns) if needle else rows
    return found.where(F.col(state) == status.upper()) if status else found


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page in order with the number of all rows; a page past the end is the last one."""
    total = rows.count()
    last = max(0, -(-total // size) - 1)
    at = min(max(number, 0), last)
    return rows.orderBy(*order).offset(at * size).limit(size).withColumn("total", F.lit(total).cast("long"))


def natural_key(name: Column) -> Column:
    """Sort key of a name in which numbers sort by value: digit runs are padded to 20 places."""
    pieces = F.regexp_extract_all(F.lower(name), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, "^0+", ""), 20, "0")).otherwise(p)), "")


def repeated_titles(rows: DataFrame, owner: str, title: str) -> DataFrame:
    """(owner, title): titles that an owner uses more than once, in any case."""
    return rows.groupBy(owner, F.lower(title).alias("title")).agg(F.count("*").alias("n")).where("n > 1").drop("n")


def new_uploads(batch: DataFrame, existing: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows of a batch whose key is neither among the existing ones nor earlier in the batch."""
    fresh = batch.join(existing.select(*key).distinct(), key, "left_anti")
    first = Window.partitionBy(*key).orderBy(order)
    return fresh.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key; as one struct aggregate, so no key's rows need sorting."""
    others = [c for c in rows.columns if c not in key]
    newest = F.max_by(F.struct(*others), F.struct(*order))
    return rows.groupBy(*key).agg(newest.alias("_r")).select(*key, "_r.*")


def basename(path: Column) -> Column:
    """File name without folders, at most 255 characters; the path itself if nothing is left."""
    name = F.regexp_replace(path, r"^.*[/\\]", "")
    return F.left(F.coalesce(F.when(name != "", name), path), F.lit(255))


def renamed(new: Column, old: Column) -> Column:
    """The new name with the old suffix, which is added if missing."""
    suffix = F.regexp_extract(old, r"(\.[^./\\]+)$", 1)
    return F.when((suffix == "") | F.lower(new).endswith(F.lower(suffix)), new).otherwise(F.concat(new, suffix))


def initials(name: Column) -> Column:
    words = F.slice(F.filter(F.split(F.coalesce(name, F.lit("")), r"\s+"), lambda w: w != ""), 1, 2)
    return F.upper(F.array_join(F.transform(words, lambda w: F.left(w, F.lit(1))), ""))


def progress(done: Column, total: Column) -> Column:
    """Percent shown while pages are extracted: 10 to 50."""
    return (10 + F.bround(40 * done / F.greatest(total, F.lit(1)))).cast("long")


# What the history calls each action and each kind of report.
ACTIONS = {
    "PROJECT_CREATED": "Проект создан", "PROJECT_UPDATED": "Проект изменён", "PROJECT_DELETED": "Проект удалён",
    "ANALYSIS_CREATED": "Документ добавлен", "ANALYSIS_STARTED": "Анализ запущен",
    "ANALYSIS_COMPLETED": "Проверка документа завершена", "ANALYSIS_FAILED": "Проверка не удалась",
    "ANALYSIS_RERUN": "Запущена повторная проверка", "DOCUMENT_REANALYZE": "Запущена повторная проверка",
    "ANALYSIS_DELETED": "Файл удалён", "DOCUMENT_RENAMED": "Документ переименован",
    "FINDING_REVIEWED": "Статус замечания изменён", "RULE_CREATED": "Правило добавлено", "RULE_UPDATED": "Правило изменено",
    "RULE_TOGGLED": "Правило отключено", "RULE_DELETED": "Правило удалено", "REPORT_DOWNLOADED": "Отчёт скачан",
}
IN_PROJECT = "Файл добавлен в проект"
TURNED_ON = "Правило включено"
REPORTS = {"brief": "Краткий отчёт", "detailed": "Подробный отчёт", "protocol": "Протокол разногласий", "annotated": "Документ с пометками"}
DOCUMENTS = ("документ", "документа", "документов")
RULES = ("правило", "правила", "правил")
CRITICAL = ("критическое замечание", "критических замечания", "критических замечаний")
DETAILS = "file string, project string, title string, documents long, rules long, critical long, warning long, low long, error string, `from` string, `to` string, status string, enabled boolean, mode string, format string"


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """The Russian form of a noun after a number."""
    last, two = n % 10, n % 100
    return F.when((last == 1) & (two != 11), one).when(last.between(2, 4) & ~two.between(12, 14), few).otherwise(many)


def history(events: DataFrame, action: str, actions: list[str] | None = None) -> DataFrame:
    """Events with a title; an unknown action is shown by its own name."""
    if actions:
        events = events.where(F.upper(F.trim(F.col(action))).isin([a.strip().upper() for a in actions]))
    title = F.coalesce(*[F.when(F.upper(action) == k, F.lit(v)) for k, v in ACTIONS.items()], F.col(action))
    return events.withColumn("title", title)


def _details() -> dict[str, list[Column]]:
    """What follows the title of an action, from the fields of ``d``; empty and missing parts are left out."""
    d = lambda name: F.col(f"d.{name}")
    number = lambda name: F.coalesce(d(name), F.lit(0))
    counted = lambda n, forms: F.concat_ws(" ", n, plural(n, *forms))
    mode = F.coalesce(*[F.when(d("mode") == k, F.lit(v)) for k, v in REPORTS.items()], d("mode"))
    renamed_to = F.concat(F.coalesce(d("from"), F.lit("None")), F.lit(" → "), F.coalesce(d("to"), F.lit("None")))
    own_title = dict.fromkeys(("PROJECT_CREATED", "PROJECT_UPDATED", "PROJECT_DELETED", "RULE_CREATED", "RULE_UPDATED", "RULE_TOGGLED", "RULE_DELETED"), [d("title")])
    own_file = dict.fromkeys(("ANALYSIS_RERUN", "DOCUMENT_REANALYZE", "ANALYSIS_DELETED"), [d("file")])
    several = F.when(d("documents") > 1, F.concat(counted(d("documents"), DOCUMENTS), F.lit(" в архиве")))
    return own_title | own_file | {
        "ANALYSIS_CREATED": [d("project"), d("file"), several],
        "ANALYSIS_STARTED": [d("project"), d("file")],
        "ANALYSIS_COMPLETED": [
            d("file"), counted(number("rules"), RULES), counted(number("critical"), CRITICAL),
            F.concat(number("warning"), F.lit(" требуют внимания")), F.when(d("low") != 0, F.concat(d("low"), F.lit(" с низким риском"))),
        ],
        "ANALYSIS_FAILED": [d("file"), d("error")],
        "DOCUMENT_RENAMED": [renamed_to],
        "FINDING_REVIEWED": [d("title"), d("status")],
        "REPORT_DOWNLOADED": [mode, F.upper(d("format"))],
    }


def described(events: DataFrame, action: str, details: str) -> DataFrame:
    """Events with a title and a detail line from their details, a JSON object; null and broken JSON say nothing.

    Files of a project and rules that are turned on have titles of their own. An unknown action is its own title.
    """
    parsed = events.withColumn("d", F.from_json(F.coalesce(details, F.lit("{}")), DETAILS))
    joined = {k: F.concat_ws(" · ", *[F.nullif(p.cast("string"), F.lit("")) for p in parts]) for k, parts in _details().items()}
    title = F.when((F.col(action) == "ANALYSIS_CREATED") & (F.col("d.project") != ""), IN_PROJECT).when((F.col(action) == "RULE_TOGGLED") & F.col("d.enabled"), TURNED_ON)
    title = title.otherwise(F.coalesce(*[F.when(F.col(action) == k, F.lit(v)) for k, v in ACTIONS.items()], F.col(action)))
    line = F.coalesce(*[F.when(F.col(action) == k, v) for k, v in joined.items()], F.lit(""))
    return parsed.withColumn("title", title).withColumn("detail", line).drop("d")


def audited(log: str, rows: DataFrame) -> None:
    """Appends rows (user, action, entity_type, entity, details) to the audit log with the time of writing."""
    rows.withColumn("at", F.current_timestamp()).write.mode("append").parquet(log)
