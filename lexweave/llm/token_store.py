"""Token-id files with Elias-Fano document boundaries.

Documents are range-partitioned and sorted by doc_id; each task writes segments of bounded size to the shared folder.
A segment holds the concatenated ids as fixed-width little-endian integers and two Elias-Fano sequences: where each
document ends, and the document ids. An Elias-Fano sequence of n values below u takes about 2 + log2(u / n) bits a
value; sampled select positions give any value without a table of 64-bit offsets. Segments are named by partition and
number, written under another name and renamed, so a retried task leaves the same files.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.llm.bpe_lexicon import _SPACE, byte_alphabet
from lexweave.llm.common import frame, make_room, map_rows, shared_dir, stage, table

END_ID = 0
SEGMENT_IDS = 4_000_000
#: Entries in each of a worker's tables of text met before, about 200 bytes each.
CACHE_CHUNKS = 700_000
#: Bytes of text that a task encodes at a time, and one text more.
ENCODE_BYTES = 8 << 20
SAMPLE = 256
_HEAD = struct.Struct("<8s4Q")
_SEQ = struct.Struct("<4Qq")


class EliasFano:
    """A non-decreasing sequence of integers; ``base`` is subtracted first, so it may start below zero."""

    def __init__(self, n: int, width: int, base: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.width, self.base, self.low, self.high, self.samples = n, width, base, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        base = int(values[0]) if n else 0
        v = values.astype(np.int64).view(np.uint64) - np.int64(base).view(np.uint64)
        width = max(0, (int(v[-1]) // n).bit_length() - 1) if n else 0
        low_bits = (v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        ones = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, width, base, np.packbits(low_bits.astype(np.uint8).ravel(), bitorder="little"), np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """The i-th value, from the nearest sampled position."""
        at = int(self.samples[i // SAMPLE])
        rest, byte = i % SAMPLE, at // 8
        offset = at - byte * 8
        while True:
            found = np.flatnonzero(np.unpackbits(self.high[byte : byte + 64], bitorder="little")[offset:])
            if rest < len(found):
                position = byte * 8 + offset + int(found[rest])
                break
            rest, byte, offset = rest - len(found), byte + 64, 0
        first = i * self.width
        window = np.unpackbits(self.low[first // 8 : (first + self.width + 7) // 8], bitorder="little")[first % 8 : first % 8 + self.width]
        return self.base + ((position - i) << self.width) + sum(int(b) << j for j, b in enumerate(window))

    def all(self) -> np.ndarray:
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little")).astype(np.uint64) - np.arange(self.n, dtype=np.uint64)
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.width].reshape(self.n, self.width).astype(np.uint64)
        low = (bits << np.arange(self.width, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return ((high << np.uint64(self.width)) + low + np.int64(self.base).view(np.uint64)).view(np.int64)

    def to_bytes(self) -> bytes:
        return _SEQ.pack(self.n, self.width, len(self.low), len(self.high), self.base) + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, width, n_low, n_high, base = _SEQ.unpack_from(data, at)
        at += _SEQ.size
        low = np.frombuffer(data, np.uint8, n_low, at)
        high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        samples = np.frombuffer(data, "<u4", -(-n // SAMPLE), at + n_low + n_high)
        return cls(n, width, base, low, high, samples), at + n_low + n_high + 4 * len(samples)


def pack_segment(ids: np.ndarray, ends: list[int], doc_ids: list[int | None]) -> bytes:
    """``ids``: all documents' ids. ``ends``: where each document ends. Null doc_ids come first."""
    named = [i for i in doc_ids if i is not None]
    parts = EliasFano.of(np.array(ends, np.int64)).to_bytes() + EliasFano.of(np.array(named, np.int64)).to_bytes()
    return _HEAD.pack(b"LXTOKEN1", len(ids), ids.itemsize, len(doc_ids) - len(named), len(parts)) + parts + ids.tobytes()


def unpack_segment(data: bytes) -> tuple[np.ndarray, EliasFano, list[int | None]]:
    magic, n, width, nulls, size = _HEAD.unpack_from(data)
    if magic != b"LXTOKEN1":
        raise ValueError("not a token segment")
    ends, at = EliasFano.read(memoryview(data), _HEAD.size)
    named, _ = EliasFano.read(memoryview(data), at)
    return np.frombuffer(data, f"<u{width}", n, _HEAD.size + size), ends, [None] * nulls + named.all().tolist()


class ChunkEncoder(dict):
    """Ids of texts by the tokenizers library, which sees each different piece of text once.

    A chunk is white space and the run of other characters after it. The vocabulary's pattern never joins a character
    to one before white space, so a text's ids are those of its chunks. Arrow cuts the texts of a batch and finds their
    different chunks; this table is asked once for each of these. Its keys are words after a single space, or after the
    line break that they then begin with. Letters and the punctuation after them are two pieces for the pattern:
    ``pieces`` holds them alone, as the vocabulary writes them. ``whole`` holds chunks as they stand.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task owns one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        other = _SPACE.replace("\t-\r ", "\t\x0b-\r")
        self.irregular = rf"[{other}]|[ \n][ \n]|\A[ \n]|[ \n]\z"
        self.chunks = re.compile(rf"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+").findall
        self.letters = re.compile(r"(\n?)([A-Za-zÀ-ÖØ-öø-ſ]+)([.,;:!?]*)").fullmatch
        self.written = str.maketrans({chr(b): c for b, c in enumerate(byte_alphabet())})
        self.line = self._encode("\n")
        self.pieces: dict[str, bytes] = {}
        self.whole: dict[str, bytes] = {}

    def _encode(self, chunk: str) -> bytes:
        return array(self.code, self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece that the pattern does not cut, from the library's model alone."""
        ids = self.pieces.get(piece)
        if ids is None:
            make_room(self.pieces, CACHE_CHUNKS)
            written = piece.encode().decode("latin-1").translate(self.written)
            ids = self.pieces[piece] = array(self.code, [t.id for t in self.tokenizer.model.tokenize(written)]).tobytes()
        return ids

    def __missing__(self, word: str) -> bytes:
        make_room(self, CACHE_CHUNKS)
        m = self.letters(word)
        if m is None:
            ids = self._encode(word if word[:1] == "\n" else " " + word)
        else:
            ids = self.line + self._piece(m[2]) if m[1] else self._piece(" " + m[2])
            if m[3]:
                ids += self._piece(m[3])
        self[word] = ids
        return ids

    def chunk(self, chunk: str) -> bytes:
        ids = self.whole.get(chunk)
        if ids is None:
            make_room(self.whole, CACHE_CHUNKS // 4)
            ids = self.whole[chunk] = self._encode(chunk)
        return ids

    def _odd(self, text: str) -> bytes:
        """Ids of a text with other white space than single spaces and line breaks, or with a special token's string."""
        if any(s in text for s in self.special):
            return self._encode(text)
        return b"".join(map(self.chunk, self.chunks(text)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each text's followed by ``END_ID``; and how many ids each text has with it."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        filled = pc.greater(pc.binary_length(texts), 0)
        plain = pc.and_(filled, pc.invert(pc.match_substring_regex(texts, self.irregular)))
        for s in self.special:
            plain = pc.and_(plain, pc.invert(pc.match_substring(texts, s)))
        # The line break in front makes the first word one like others; its id is taken off again below.
        line, nothing = (pa.scalar(x, pa.large_string()) for x in ("\n", ""))
        words = pc.split_pattern(pc.binary_join_element_wise(line, pc.replace_substring(texts.filter(plain), "\n", " \n"), nothing), " ")
        coded = words.flatten().dictionary_encode()
        entries = [self[w] for w in coded.dictionary.to_pylist()]
        place = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = words.offsets.to_numpy() - words.offsets[0].as_py()
        first, at = np.unique(place[bounds[:-1]], return_inverse=True)
        place[bounds[:-1]] = len(entries) + at
        entries += [entries[k][len(self.line) :] for k in first.tolist()]

        is_plain, is_filled = (x.to_numpy(zero_copy_only=False) for x in (plain, filled))
        odd = np.flatnonzero(is_filled & ~is_plain)
        odd_place = len(entries) + np.arange(len(odd))
        entries += [self._odd(t) for t in texts.take(pa.array(odd)).to_pylist()]
        entries.append(np.array([END_ID], self.dtype).tobytes())
        parts = is_filled.astype(np.int64)  # chunks of each text: those of a plain one, one for an odd one, none
        parts[is_plain] = np.diff(bounds)
        stop = np.cumsum(parts + 1)
        sequence = np.full(int(stop[-1]) if len(stop) else 0, len(entries) - 1)
        of_text, is_end = np.repeat(np.arange(len(parts)), parts + 1), np.zeros(len(sequence), bool)
        is_end[stop - 1] = True
        sequence[is_plain[of_text] & ~is_end] = place
        sequence[(is_filled & ~is_plain)[of_text] & ~is_end] = odd_place

        data = np.frombuffer(b"".join(entries), self.dtype)
        sizes = np.fromiter(map(len, entries), np.int64, len(entries)) // self.dtype.itemsize
        own = sizes[sequence]
        ends = np.cumsum(own)
        source = np.repeat((np.cumsum(sizes) - sizes)[sequence] - (ends - own), own) + np.arange(int(ends[-1]) if len(ends) else 0)
        return data[source], np.diff(ends[stop - 1], prepend=0)


@lru_cache(maxsize=2)
def chunk_encoder(path: str) -> ChunkEncoder:
    """One for each worker process, which runs many tasks."""
    return ChunkEncoder(path)


def blocks(batches: Iterator[pa.RecordBatch], most: int = ENCODE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in batches of about so many bytes of text."""
    held, size = [], 0
    for batch in batches:
        done = 0
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column("text").cast(pa.large_string())), 0)).to_numpy()
        while done < len(batch):
            before = int(ends[done - 1]) if done else 0
            stop = min(len(batch), int(np.searchsorted(ends, before + most - size)) + 1)
            held.append(batch.slice(done, stop - done))
            size += int(ends[stop - 1]) - before
            done = stop
            if size >= most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def write_segments(docs: DataFrame, folder: str, tokenizer: str, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Writes all documents' ids under ``folder`` (a URI that executors share); returns the staged list of segments:
    part, seq, path, n_docs, n_ids, start (ids before the segment)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        encoder = chunk_encoder(tokenizer)
        fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        fs.create_dir(root, recursive=True)
        seq, chunks, ends, ids, total = 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, chunks, ends, ids, total
            name = f"{root}/part-{part:06d}-{seq:05d}.tok"
            with fs.open_output_stream(f"{name}.{attempt}") as f:
                f.write(pack_segment(np.frombuffer(b"".join(chunks), encoder.dtype), ends, ids))
            fs.move(f"{name}.{attempt}", name)
            row = frame({"part": ([part], pa.int32()), "seq": ([seq], pa.int32()), "path": ([name], pa.string()), "n_docs": ([len(ids)], pa.int64()), "n_ids": ([total], pa.int64())})
            seq, chunks, ends, ids, total = seq + 1, [], [], [], 0
            return row

        for b in blocks(batches):
            coded, counts = encoder.encode(b.column("text"))
            stops = np.cumsum(counts).tolist()
            for i, p, q in zip(b.column("doc_id").to_pylist(), [0, *stops], stops, strict=False):
                chunks.append(coded[p:q].tobytes())
                total += q - p
                ends.append(total)
                ids.append(i)
                if total >= segment_ids:
                    yield flush()
        if ids:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    listed = stage(map_rows(ordered, write, "part int, seq int, path string, n_docs long, n_ids long"), "segments")
    before, starts = 0, []  # one row for each partition
    for r in listed.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        starts.append((r["part"], before))
        before += r["n"]
    offsets = spark.createDataFrame(starts, "part int, offset long")
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return listed.join(F.broadcast(offsets), "part").withColumn("start", F.col("offset") + within).drop("offset")


def read_segments(segments: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = pafs.FileSystem.from_uri(folder)[0] if "://" in folder or folder.startswith("file:") else pafs.LocalFileSystem()
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                with fs.open_input_stream(path) as f:
                    ids, ends, doc_ids = unpack_segment(f.read())
                stops = [ends.select(i) for i in range(ends.n)]
                begins = [0, *stops[:-1]]
                crcs = [zlib.crc32(ids[p:q].astype("<u4").tobytes()) for p, q in zip(begins, stops, strict=True)]
                yield frame({"doc_id": (doc_ids, pa.int64()), "start": ([start + p for p in begins], pa.int64()), "n_tokens": ([q - p for p, q in zip(begins, stops, strict=True)], pa.int64()), "ids_crc32": (crcs, pa.int64())})

    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_rows(segments.select("path", "start").repartition(parts, "path"), read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null text counts as empty; null doc_ids come first, repeated ones in order of their texts; equal rows stay apart.

    An empty table leaves no file and no row. Other columns are ignored, whatever their names.
    """
    folder = f"{shared_dir(spark)}/lexweave-tokens-{uuid.uuid4().hex}"
    return read_segments(write_segments(table(spark, sf_dir, "documents"), folder, default_tokenizer()), folder)
