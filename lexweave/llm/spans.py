"""Spans found by regular expressions, with DataFrame functions alone.

A span is a struct (start, kind, end, value) in code points, end exclusive; kind is a number so that sorting an array
of spans sorts by start, then by the order in which the kinds are listed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:bigint,kind:int,end:bigint,value:string>"
#: Bits of a membership filter; its size is the same for every corpus (8 MB).
FILTER_BITS = 1 << 26
#: Values that one fold gathers.
BLOCK = 256


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression that names a value and computes it once."""
    return F.transform(F.array(value), body)[0]


def running_sums(values: Column) -> Column:
    """The sums of an array of longs from its first value to each. Block by block, as each step of a fold copies what the
    fold has gathered."""

    def sums(part: Column, at: Column) -> Column:
        zero = F.struct(at.alias("at"), F.array().cast("array<bigint>").alias("out"))
        add = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"] + x).alias("out"))
        return F.aggregate(part, zero, add, lambda acc: acc["out"])

    zero = F.lit(0).cast("long")
    blocks = let(values, lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / BLOCK).cast("int")), lambda k: F.slice(v, k * BLOCK + 1, F.lit(BLOCK))))
    whole = lambda all_blocks: sums(F.transform(all_blocks, lambda b: F.aggregate(b, zero, lambda x, y: x + y)), zero)
    before = lambda ends, k: F.coalesce(F.get(ends, k - 1), zero)
    return let(blocks, lambda all_blocks: let(whole(all_blocks), lambda ends: F.flatten(F.transform(all_blocks, lambda b, k: sums(b, before(ends, k))))))


def find(text: Column, pattern: str, kind: int, possible: Column, group: int = 0) -> Column:
    """Leftmost matches that do not overlap. ``split`` returns what lies between the same matches, so the lengths of
    both add up to the positions. ``value`` is the ``group`` of the match. ``possible`` is a cheap test that a match
    needs; a null text has no spans."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(F.split(text, pattern, -1), whole, lambda gap, m: F.struct(F.length(gap).cast("long").alias("gap"), F.length(m).cast("long").alias("len"), m.alias("m")))
    if group:
        pieces = F.zip_with(pieces, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda p, v: F.struct(p["gap"].alias("gap"), p["len"].alias("len"), v.alias("m")))
    size = lambda p: p["gap"] + F.coalesce(p["len"], F.lit(0).cast("long"))
    span = lambda p, end: F.struct((end - p["len"]).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), p["m"].alias("value")).cast(SPAN)
    spans = let(pieces, lambda all_pieces: F.zip_with(all_pieces, running_sums(F.transform(all_pieces, size)), span))
    return F.when(possible, F.filter(spans, lambda s: s["start"].isNotNull())).otherwise(no_spans())


def written(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with each run of overlapping spans replaced by ``mask``; spans must be sorted."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    end = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, add, end)).otherwise(text)


def maybe_marked(df: DataFrame, column: str, keys: DataFrame, name: str) -> DataFrame:
    """``df`` with a boolean: false only where ``column`` is not among ``keys`` (one column), or null.

    A bitmap of fixed size is broadcast. It is true for all rows with a key, and for few others.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)) + 1
    bitmap = keys.select(bit(keys.columns[0]).alias("_h")).groupBy(F.bitmap_bucket_number("_h").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_h")).alias("_bits"))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(bitmap_bit_position(_h) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.expr("shiftright(_byte, cast(bitmap_bit_position(_h) % 8 as int)) % 2 = 1")
    marked = df.withColumn("_h", F.when(F.col(column).isNotNull(), bit(column))).withColumn("_bucket", F.bitmap_bucket_number("_h"))
    return marked.join(F.broadcast(bitmap), "_bucket", "left").withColumn("_byte", byte).select(*df.columns, F.coalesce(hit, F.lit(False)).alias(name))


def maybe_in(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``column`` can be among ``keys`` (one column), as ``maybe_marked`` says; an exact join follows."""
    return maybe_marked(df, column, keys, "_in").where("_in").drop("_in")
