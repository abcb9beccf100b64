"""Token counts by a two-tier lookup of pre-tokens, map-side.

A text is cut where no vocabulary piece can reach across, so that the tokens of the parts add up to the tokens of the
text. The lengths of frequent parts are broadcast as a compact table that Arrow probes for a whole batch at once; the
others are encoded by the library through a cache that each worker keeps. Parts never leave their task: what is
frequent is found by mergeable summaries of fixed size, one for each task.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import frame, make_room, map_rows, spent, stage, table

#: Entries of the broadcast table, of at most ``MAX_BYTES`` bytes each: 3 MB in all.
FREQUENT, MAX_BYTES = 32_768, 64
#: Counters of a summary: a part that makes up one in so many of all parts is never missed.
COUNTERS = 2 * FREQUENT
#: Entries in a worker's cache of lengths, about 150 bytes each.
CACHE_PARTS = 400_000
#: Bytes of text that are cut at once.
SLICE_BYTES = 8 << 20
LIMIT = 4096
SPACE, CUT = "▁", "\x1f"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A vocabulary file with the library's processor, for parts of texts: no space is put before them."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules = model.normalizer_spec
        plain = not rules.precompiled_charsmap and not rules.remove_extra_whitespaces and rules.escape_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
        texts = [p.piece for p in model.pieces if p.type not in (2, 3, 6)]  # without unknown, control and byte pieces
        #: Whether spaces part texts; else a whole text is one part.
        self.parted = plain and model.trainer_spec.model_type == 2 and not any(SPACE in t.lstrip(SPACE) for t in texts)
        #: Whether a line break is never part of a longer piece.
        self.by_line = self.parted and not any("\n" in t and len(t) > 1 for t in texts)
        self.prefix = SPACE if rules.add_dummy_prefix else ""
        self.whole = SentencePieceProcessor(model_proto=model.SerializeToString())
        rules.add_dummy_prefix = False
        self.encode = SentencePieceProcessor(model_proto=model.SerializeToString()).encode
        self.cut = regex.compile(rf"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+" if self.by_line else rf"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
        self.lengths: dict[str, int] = {}

    def length(self, part: str) -> int:
        """Tokens of a part, through the cache."""
        n = self.lengths.get(part)
        if n is None:
            n = len(self.encode(part))
            if len(part) <= MAX_BYTES:
                make_room(self.lengths, CACHE_PARTS)
                self.lengths[part] = n
        return n

    def parts(self, texts: pa.Array, odd: bool) -> tuple[pa.Array, np.ndarray]:
        """The parts of all texts in order, and where each text's begin and the last one's end. Parts may be empty.

        Texts that aren't ``odd`` have no runs of spaces, so that each space begins a part.
        """
        if odd:
            lists = [self.cut((self.prefix + t).replace(" ", SPACE)) if t else [] for t in texts.to_pylist()]
            ends = np.cumsum([0, *map(len, lists)])
            return pa.array([p for parts in lists for p in parts], pa.string()), ends
        cut = pc.replace_substring(texts, " ", CUT + SPACE)
        if self.by_line:
            cut = pc.replace_substring(cut, "\n", f"{CUT}\n{CUT}")
        begun = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(self.prefix, cut, ""))
        lists = pc.split_pattern(begun, CUT)
        return lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with a bounded number of bytes of text, or with one text."""
    sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
    first = 0
    while first < batch.num_rows:
        base = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, base + SLICE_BYTES, "right")))
        yield batch.slice(first, last - first)
        first = last


def cuttable(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """In slices, the rows whose texts Arrow can cut, then the odd ones with runs of spaces and the like."""
    for part in slices(batch):
        odd = pc.match_substring_regex(part.column("text"), f"^ |  |{SPACE}|{CUT}")
        for mask, is_odd in ((pc.invert(odd), False), (odd, True)):
            if pc.any(mask).as_py():
                yield part.filter(mask), is_odd


def shrink(counts: Counter, counters: int) -> None:
    """Keeps the ``counters`` largest and takes the next one's count from each: sums of such summaries still hold every
    part that makes up one in ``counters`` of all."""
    if len(counts) > counters:
        floor = heapq.nlargest(counters + 1, counts.values())[-1]
        kept = {p: n - floor for p, n in counts.items() if n > floor}
        counts.clear()
        counts.update(kept)


def frequent_parts(texts: DataFrame, model: str, most: int = FREQUENT) -> list[str]:
    """The most frequent parts of all texts. Each task summarises its texts, summaries are merged as they lie in the
    written files, and the driver merges one for each split of those: no part is ever shuffled."""
    schema = "parts array<string>, counts array<long>"

    def row(counts: Counter) -> pa.RecordBatch:
        shrink(counts, COUNTERS)
        return frame({"parts": ([list(counts)], pa.list_(pa.string())), "counts": ([list(counts.values())], pa.list_(pa.int64()))})

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts = pieces(model), Counter()
        for batch in batches:
            for b, odd in cuttable(batch):
                parts, _ = own.parts(b.column("text"), odd)
                coded = pc.dictionary_encode(parts)
                for part, n in zip(coded.dictionary.to_pylist(), np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)).tolist(), strict=True):
                    if len(part) <= MAX_BYTES and len(part.encode()) <= MAX_BYTES:
                        counts[part] += n
            if len(counts) > 8 * COUNTERS:
                shrink(counts, COUNTERS)
        yield row(counts)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for r in b.to_pylist():
                for part, n in zip(r["parts"], r["counts"], strict=True):
                    counts[part] += n
                shrink(counts, COUNTERS)
        yield row(counts)

    summaries = stage(map_rows(texts.select("text"), summarise, schema), "summaries")
    counts: Counter = Counter()
    for r in map_rows(summaries, merge, schema).toLocalIterator():
        for part, n in zip(r["parts"], r["counts"], strict=True):
            counts[part] += n
        shrink(counts, COUNTERS)
    spent(summaries)
    return [part for part, _ in heapq.nlargest(most, counts.items(), key=lambda e: (e[1], e[0]))]


def compact_table(parts: list[str], model: str) -> bytes:
    """Parts and the numbers of their tokens as an Arrow stream."""
    own = pieces(model)
    batch = pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array([own.length(p) for p in parts], pa.uint16())], names=["part", "n"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def count_tokens(docs: DataFrame, model: str | None = None, limit: int = LIMIT, frequent: int = FREQUENT) -> DataFrame:
    """Per document row: doc_id, n_bytes, n_tokens, over_limit.

    A null text counts as empty and has no bytes and no tokens. Equal rows stay apart; an empty table has no rows; other
    columns are ignored, whatever their names. ``model`` is a path that every executor can read. A vocabulary with
    pieces that reach across spaces, or with rules for normal forms, encodes whole texts by the library.
    """
    path = model or default_model()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parted = pieces(path).parted
    sent = docs.sparkSession.sparkContext.broadcast(compact_table(frequent_parts(texts, path, frequent), path)) if parted else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        if parted:
            known = pa.ipc.open_stream(sent.value).read_all()
            values, lengths = known.column("part").combine_chunks(), known.column("n").to_numpy()
        for batch in batches:
            for b, odd in cuttable(batch) if parted else ((x, True) for x in slices(batch)):
                if parted:
                    parts, ends = own.parts(b.column("text"), odd)
                    place = pc.index_in(parts, value_set=values)
                    missed = place.is_null().to_numpy(zero_copy_only=False)
                    each = np.zeros(len(parts), np.int64)
                    each[~missed] = lengths[place.drop_null().to_numpy()]
                    each[missed] = [own.length(p) for p in parts.filter(pa.array(missed)).to_pylist()]
                    sums = np.concatenate(([0], np.cumsum(each)))
                    n = sums[ends[1:]] - sums[ends[:-1]]
                else:
                    n = np.array([len(own.whole.encode(t)) for t in b.column("text").to_pylist()], np.int64)
                size = pc.binary_length(b.column("text")).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), size, pa.array(n, pa.int64()), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_rows(texts, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
