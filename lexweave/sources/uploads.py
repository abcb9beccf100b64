"""Files: checks of uploads, archives, seed rules, and snapshots that replace a part of a table."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted suffixes with the bytes their files begin with (none: any), and the limits of an upload.
SIGNATURES = {
    ".pdf": "25504446", ".docx": "504B", ".doc": "D0CF11E0", ".rtf": "7B5C727466", ".odt": "504B", ".txt": "", ".png": "",
    ".jpg": "", ".jpeg": "", ".tif": "", ".tiff": "", ".bmp": "", ".zip": "504B",
}
MAX_BYTES = 100 * 1024 * 1024
MAX_FILES = 300
MAX_UNPACKED = 1024 * 1024 * 1024
MAX_DEPTH = 2
JUNK_DIRS = ("__MACOSX",)
JUNK_PREFIXES = ("~$", "._")
JUNK_NAMES = (".DS_Store", "Thumbs.db", "desktop.ini")
UNSAFE = r'[<>:"/\\|?*\x00-\x1f]'
NAME_CHARS = 200
#: Unpacked bytes of an archive that one task takes, and those of one batch of its members.
SHARE_BYTES = 64 * 1024 * 1024
BATCH_BYTES = 8 * 1024 * 1024
MEMBERS = "path string, member string, size long, error string, content binary"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of all files under a folder; Spark passes over files of no bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "content")


def file_stream(spark: SparkSession, path: str, max_bytes: int = SHARE_BYTES) -> DataFrame:
    """The same as a stream of the files that arrive in a folder; a trigger takes ``max_bytes`` of them, or one file."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    source = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxBytesPerTrigger", str(max_bytes))
    return source.load(path).select("path", "length", "content")


def checked_uploads(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files (path, length, content) with ``reason``: null for a good one, else the first check that fails."""
    kind = suffix(F.col("path"))
    head = F.hex(F.substring("content", 1, 1024))
    magic = F.lit(True)
    for name, start in SIGNATURES.items():
        found = F.instr(head, start) > 0 if name == ".pdf" else head.startswith(start)
        magic = F.when(kind == name, found).otherwise(magic)
    reason = F.when(~kind.isin(*SIGNATURES), "unsupported").when(F.coalesce("length", F.lit(0)) == 0, "empty").when(F.col("length") > max_bytes, "too large").when(~F.coalesce(magic, F.lit(False)), "wrong content")
    return files.withColumn("suffix", kind).withColumn("reason", reason)


def member_name(info: zipfile.ZipInfo) -> str:
    """The name as its writer meant it: UTF-8 if flagged or if it reads so, else the code pages of old tools."""
    if info.flag_bits & 0x800:
        return info.filename
    raw = info.filename.encode("cp437", errors="replace")
    for page in ("utf-8", "cp866", "cp1251"):
        try:
            return raw.decode(page)
        except UnicodeDecodeError:
            continue
    return info.filename


def safe_path(name: str) -> str | None:
    """A path below the folder, or None for one that leaves it or is junk of the operating system.

    Characters that file systems refuse become underscores; spaces and dots at the ends go; a name keeps 200 characters.
    """
    parts = [p for p in name.replace("\\", "/").split("/") if p not in ("", ".")]
    if not parts or ".." in parts or ":" in parts[0]:
        return None
    parts = [re.sub(UNSAFE, "_", p).strip(" .")[:NAME_CHARS] or "file" for p in parts]
    if any(p in JUNK_DIRS for p in parts) or parts[-1].startswith(JUNK_PREFIXES) or parts[-1] in JUNK_NAMES:
        return None
    return "/".join(parts)


class Refused(Exception):
    """An archive that is not taken, with the member that decides it and the reason."""


def listed(content: bytes, max_files: int, max_bytes: int, depth: int = MAX_DEPTH) -> list[tuple[str, zipfile.ZipFile, zipfile.ZipInfo]]:
    """All members in order of their paths, those of archives inside down to ``depth`` levels, none of them unpacked.

    Archives count as files of the upload. Those that lie deeper are left out. One member that is encrypted, or one
    file or byte too many, refuses the upload.
    """
    waiting, taken, files, size = [("", content, depth)], [], 0, 0
    while waiting:
        folder, data, levels = waiting.pop()
        try:
            archive = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile:
            raise Refused(folder, "not a ZIP") from None
        for info in archive.infolist():
            own = None if info.is_dir() else safe_path(member_name(info))
            if own is None:
                continue
            path = f"{folder}/{own}" if folder else own
            files, size = files + 1, size + info.file_size
            reason = "encrypted" if info.flag_bits & 1 else "too many files" if files > max_files else "too large" if size > max_bytes else None
            if reason:
                raise Refused(path, reason)
            if not own.lower().endswith(".zip"):
                taken.append((path, archive, info))
            elif levels:
                waiting.append((path, archive.read(info), levels - 1))
    return sorted(taken, key=lambda m: m[0].lower())


def unpack(content: bytes, max_files: int, max_bytes: int, depth: int = MAX_DEPTH) -> list[tuple[str, bytes]]:
    """(path, content) of what ``listed`` names."""
    return [(path, archive.read(info)) for path, archive, info in listed(content, max_files, max_bytes, depth)]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"path": pa.string(), "member": pa.string(), "size": pa.int64(), "error": pa.string(), "content": pa.binary()}
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def exploded_archives(files: DataFrame, max_files: int = MAX_FILES, max_bytes: int = MAX_UNPACKED, share_bytes: int = SHARE_BYTES) -> DataFrame:
    """(path, member, size, suffix, supported, error, content) of ZIP files: a row for each member, or one with the error.

    Only the directories are read at first. An archive that unpacks to more than ``share_bytes`` is then sent to several
    tasks, of which each unpacks its share of the members, one after the other; a member is never split. An empty or null
    content is not a ZIP; an archive without members is an error too.
    """

    def members(content: bytes | None) -> tuple[list, tuple[str, str] | None]:
        try:
            found = listed(content or b"", max_files, max_bytes)
        except Refused as refused:
            return [], refused.args
        return found, None if found else ("", "no files")

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, content in enumerate(b.column("content")):
                found, _ = members(content.as_py())
                shares = [0, *(at // share_bytes for at in accumulate(info.file_size for _, _, info in found))][: max(1, len(found))]
                firsts = [k for k in range(len(shares)) if k == 0 or shares[k] != shares[k - 1]]
                n = len(firsts)
                bounds = [pa.array(firsts, pa.int32()), pa.array([*firsts[1:], len(found)], pa.int32())]
                yield pa.RecordBatch.from_arrays([b.column("path").take(pa.array([i] * n)), b.column("content").take(pa.array([i] * n)), *bounds], names=["path", "content", "first", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content, first, end in zip(*b.columns, strict=True):
                found, error = members(content.as_py())
                if error:
                    yield _rows([(path.as_py(), error[0], 0, error[1], None)])
                rows, size = [], 0
                for member, archive, info in found[first.as_py() : end.as_py()]:
                    rows.append((path.as_py(), member, info.file_size, None, archive.read(info)))
                    size += info.file_size
                    if size > BATCH_BYTES:
                        yield _rows(rows)
                        rows, size = [], 0
                if rows:
                    yield _rows(rows)

    shares = files.select("path", "content").mapInArrow(share, "path string, content binary, first int, end int")
    if not files.isStreaming:  # a stream's batch is small already
        shares = shares.repartition("path", "first")
    rows = shares.mapInArrow(run, MEMBERS)
    kind = suffix(F.col("member"))
    return rows.select("path", "member", "size", kind.alias("suffix"), (kind.isin(*SIGNATURES) & (kind != ".zip")).alias("supported"), "error", "content")


def uploaded_documents(files: DataFrame) -> DataFrame:
    """(path, member, size, supported, error, content): what an upload's files bring in, those of archives included.

    A file that fails a check has a row with the reason, and so has an archive that is refused.
    """
    checked = checked_uploads(files)
    taken = checked.where("reason IS NULL AND suffix <> '.zip'").select("path", F.substring_index("path", "/", -1).alias("member"), F.col("length").alias("size"), F.lit(True).alias("supported"), F.lit(None).cast("string").alias("error"), "content")
    refused = checked.where("reason IS NOT NULL").select("path", F.lit("").alias("member"), F.lit(0).cast("long").alias("size"), F.lit(False).alias("supported"), F.col("reason").alias("error"), F.lit(None).cast("binary").alias("content"))
    archives = exploded_archives(checked.where("reason IS NULL AND suffix = '.zip'")).select("path", "member", "size", F.coalesce("supported", F.lit(False)).alias("supported"), "error", "content")
    return taken.unionByName(refused).unionByName(archives)


def replaced(table: DataFrame, part: DataFrame, keys: list[str]) -> DataFrame:
    """A snapshot in which the rows of the part's keys are those of the part: idempotent if written again."""
    return table.join(part.select(*keys).distinct(), keys, "left_anti").unionByName(part)


def without(table: DataFrame, deleted: DataFrame, key: str, parent: str) -> DataFrame:
    """A child table after its deleted parents are gone."""
    return table.join(deleted.select(F.col(parent).alias(key)).distinct(), key, "left_anti")
