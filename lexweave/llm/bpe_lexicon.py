"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

The words of the whole corpus are counted; the ``max_words`` most frequent are compiled, with their token ids as
outputs, into a minimal acyclic automaton: equal suffixes share states, and the numbers on the arcs add up to a word's
place in the output table. Its bytes are broadcast, written once on each executor and mapped into memory. A word
outside the automaton is merged exactly, so the automaton changes the speed and never the ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import struct
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import frame, keeps_cache, map_rows, stage, table

MAX_WORDS = 20_000
#: Words in a worker's tables of words met before, about 350 bytes each, and in a task's counter before it is emptied.
CACHE_WORDS, COUNTED_WORDS = 440_000, 400_000
#: Ids are packed in so many bits.
_BITS = 20
_MASK = (1 << _BITS) - 1
_NONE = 1 << 60
_LATIN_LOWER = bytes(ord(chr(b).lower()) for b in range(256))
_SPACE = "\t-\r \x85\xa0  -     　"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class Bpe:
    """Byte-pair merges of a vocabulary file whose words end in a suffix; reads its rules from the file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.added).items()}
        # left id and right id -> rank and new id, packed into integers
        ids = self.ids
        self.pairs = {ids[a] << _BITS | ids[b]: r << _BITS | ids[a + b] for r, (a, b) in enumerate(model["merges"])}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.pieces = regex.compile(split.replace("\\s", _SPACE)).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        alphabet, suffix = byte_alphabet(), model["end_of_word_suffix"] or ""
        self.inner, self.final = [ids[c] for c in alphabet], [ids[c + suffix] for c in alphabet]
        self.spaces = regex.compile(f"[{_SPACE}]+")

    def normal(self, text: str) -> str:
        """NFC, then lower case character by character (a final sigma is not special). Latin texts have nothing to compose
        and are lowered as bytes."""
        try:
            return text.encode("latin-1").translate(_LATIN_LOWER).decode("latin-1")
        except UnicodeEncodeError:
            return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def words(self, text: str) -> list[str]:
        """What white space separates in a normalised text."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # str.split takes these for space, the vocabulary doesn't
            return [w for w in self.spaces.split(text) if w]
        return text.split()

    def merge(self, piece: str) -> list[int]:
        """Exact merges of one piece: the pair of least rank first, the leftmost of equals."""
        data = piece.encode()
        ids = [self.inner[b] for b in data[:-1]] + [self.final[data[-1]]]
        if len(ids) > 256:
            return self._merge_long(ids)
        get = self.pairs.get
        ranks = [get(a << _BITS | b, _NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            ids[i : i + 2] = [least & _MASK]
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << _BITS | ids[i], _NONE)
            if i < len(ranks):
                ranks[i] = get(ids[i] << _BITS | ids[i + 1], _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap and links, so that one very long word costs n log n."""
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        get = self.pairs.get
        heap = [(r, i) for i in range(len(ids) - 1) if (r := get(ids[i] << _BITS | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or get(ids[i] << _BITS | ids[j]) != r:
                continue
            ids[i], ids[j] = r & _MASK, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (new := get(ids[a] << _BITS | ids[b])) is not None:
                    heapq.heappush(heap, (new, a))
        return [i for i in ids if i >= 0]

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    return Bpe(path)


def compile_lexicon(entries: dict[str, list[int]]) -> bytes:
    """A minimal acyclic automaton over the UTF-8 of the words, with the outputs in order of the words."""
    words = sorted((w.encode(), ids) for w, ids in entries.items())
    register: dict[tuple, dict] = {}
    root: dict = {"final": False, "arcs": {}}
    path: list[tuple[dict, int, dict]] = []  # the unminimised states of the word before

    def settle(depth: int) -> None:
        while len(path) > depth:
            parent, label, node = path.pop()
            key = (node["final"], *((b, id(t)) for b, t in node["arcs"].items()))
            parent["arcs"][label] = register.setdefault(key, node)

    last = b""
    for word, _ in words:
        common = len(os.path.commonprefix([last, word]))
        settle(common)
        node = path[-1][2] if path else root
        for b in word[common:]:
            node["arcs"][b] = new = {"final": False, "arcs": {}}
            path.append((node, b, new))
            node = new
        node["final"] = True
        last = word
    settle(0)

    order, number, stack = [], {}, [root]
    while stack:
        node = stack.pop()
        if id(node) not in number:
            number[id(node)] = len(order)
            order.append(node)
            stack.extend(node["arcs"].values())
    below: dict[int, int] = {}

    def count(top: dict) -> int:
        todo = [top]
        while todo:
            node = todo[-1]
            missing = [t for t in node["arcs"].values() if id(t) not in below]
            if missing:
                todo.extend(missing)
            else:
                below[id(node)] = node["final"] + sum(below[id(t)] for t in node["arcs"].values())
                todo.pop()
        return below[id(top)]

    count(root)
    first, labels, targets, skips = [0], bytearray(), [], []
    for node in order:
        skip = int(node["final"])
        for b, t in node["arcs"].items():
            labels.append(b)
            targets.append(number[id(t)])
            skips.append(skip)
            skip += below[id(t)]
        first.append(len(labels))
    final = bytes(int(n["final"]) for n in order)
    bounds = np.concatenate(([0], np.cumsum([len(ids) for _, ids in words]))) if words else np.zeros(1)
    arrays = [np.array(x, np.uint32).tobytes() for x in (first, targets, skips, bounds, [i for _, ids in words for i in ids])] + [final, bytes(labels)]
    head = struct.pack("<8s7Q", b"LXMAFSA1", *map(len, arrays))
    return head + b"".join(arrays)


class Lexicon:
    """Reads a compiled lexicon from a file through a memory map."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        sizes = struct.unpack_from("<8s7Q", self.map)[1:]
        view, at, parts = memoryview(self.map), struct.calcsize("<8s7Q"), []
        for size in sizes:
            parts.append((at, view[at : at + size]))
            at += size
        self.first, self.targets, self.skips, self.bounds, self.out = (p.cast("I") for _, p in parts[:5])
        self.final, self.labels = parts[5][1], parts[6][0]

    def get(self, word: str) -> list[int] | None:
        state = place = 0
        find, first, base = self.map.find, self.first, self.labels
        for b in word.encode():
            arc = find(b.to_bytes(), base + first[state], base + first[state + 1]) - base
            if arc < 0:
                return None
            place += self.skips[arc]
            state = self.targets[arc]
        return self.out[self.bounds[place] : self.bounds[place + 1]].tolist() if self.final[state] else None


def place_lexicon(blob: bytes) -> str:
    """Writes the bytes once to this machine's temporary folder, where its workers map them and share the pages."""
    path = os.path.join(tempfile.gettempdir(), f"lexweave-{hashlib.sha256(blob).hexdigest()[:24]}.lex")
    if not os.path.exists(path):
        with tempfile.NamedTemporaryFile(dir=tempfile.gettempdir(), delete=False) as f:
            f.write(blob)
        os.replace(f.name, path)
    return path


class Encoder(dict):
    """word -> (ids joined by spaces, tokens joined by spaces), filled as words are met and bounded.

    A full table becomes the old one, out of which words that are met again come back; the rest goes with the next turn.
    """

    def __init__(self, model: Bpe, lexicon: Lexicon) -> None:
        super().__init__()
        self.model, self.lexicon = model, lexicon
        self.old: dict[str, tuple[str, str]] = {}

    def piece_ids(self, piece: str) -> list[int]:
        ids = self.lexicon.get(piece)
        return self.model.merge(piece) if ids is None else ids

    def __missing__(self, word: str) -> tuple[str, str]:
        entry = self.old.get(word)
        if entry is None:
            ids = [i for piece in self.model.pieces(word) for i in self.piece_ids(piece)]
            entry = (" ".join(map(str, ids)), self.model.decode(ids))
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS // 2:
                self.old = dict(self)
                self.clear()
            self[word] = entry
        return entry

    def __call__(self, text: str | None) -> tuple[str, str]:
        """The ids and the decoded text, each joined by spaces."""
        model, entries = self.model, []
        text = text or ""
        for part in model.special.split(text) if any(a in text for a in model.added) else (text,):
            if part in model.added:
                entries.append((str(model.added[part]), part))
            elif part:
                entries.extend(map(self.__getitem__, model.words(model.normal(part))))
        ids, tokens = zip(*entries, strict=True) if entries else ((), ())
        return " ".join(ids), " ".join(tokens)


@lru_cache(maxsize=1)
def encoder_for(tokenizer: str, lexicon: str) -> Encoder:
    """One for each worker process, which runs many tasks."""
    return Encoder(bpe(tokenizer), Lexicon(lexicon))


keeps_cache(__name__, encoder_for.cache_clear)


def frequent_words(docs: DataFrame, tokenizer: str, max_words: int = MAX_WORDS) -> list[str]:
    """The most frequent pieces of all texts, at most ``max_words``; pieces of one frequency class go together."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = bpe(tokenizer), Counter()

        def emit() -> pa.RecordBatch:
            pieces: Counter = Counter()
            for word, n in seen.items():
                for piece in model.pieces(word):
                    if len(piece) <= 64:  # longer ones are never frequent enough to matter; they are merged when met
                        pieces[piece] += n
            seen.clear()
            return frame({"piece": (list(pieces), pa.string()), "n": (list(pieces.values()), pa.int64())})

        for b in batches:
            for text in b.column("text").to_pylist():
                seen.update(model.words(model.normal(text or "")))
                if len(seen) > COUNTED_WORDS:
                    yield emit()
        yield emit()

    counted = map_rows(docs.select(F.col("text").cast("string")), count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    # Sixteen classes of frequency to each doubling: the driver sees a count for each class, then one class after another.
    classed = stage(counted.withColumn("class", F.floor(F.log2("n") * 16)), "words")
    taken, least = 0, None
    for r in classed.groupBy("class").agg(F.count("*").alias("pieces")).orderBy(F.desc("class")).collect():
        if taken + r["pieces"] > max_words:
            break
        taken, least = taken + r["pieces"], r["class"]
    return [] if least is None else [r["piece"] for r in classed.where(F.col("class") >= least).select("piece").collect()]


def encode(docs: DataFrame, tokenizer: str | None = None, max_words: int = MAX_WORDS, digests: bool = False) -> DataFrame:
    """Per document row: doc_id, n_tokens, ids (array of int) and decoded (string).

    With ``digests`` the last two are ids_sha256 and decoded_sha256, so that long arrays need not leave the task. A null
    text counts as empty and has no tokens. Equal rows stay apart; other columns are ignored. ``tokenizer`` is a path
    that every executor can read.
    """
    path = tokenizer or default_tokenizer()
    model = bpe(path)
    blob = compile_lexicon({w: model.merge(w) for w in frequent_words(docs, path, max_words)})
    sent = docs.sparkSession.sparkContext.broadcast(blob)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path, place_lexicon(sent.value))
        for b in batches:
            rows = [encoder(t) for t in b.column("text").to_pylist()]
            out = {"doc_id": (b.column("doc_id").to_pylist(), pa.int64()), "n_tokens": ([r[0].count(" ") + 1 if r[0] else 0 for r in rows], pa.int64())}
            if digests:
                out |= {f"{c}_sha256": ([hashlib.sha256(r[k].encode()).hexdigest() for r in rows], pa.string()) for k, c in enumerate(("ids", "decoded"))}
            else:
                out |= {"ids": ([list(map(int, r[0].split())) for r in rows], pa.list_(pa.int32())), "decoded": ([r[1] for r in rows], pa.string())}
            yield frame(out)

    kept = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, f"doc_id long, n_tokens long, {kept}")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), digests=True)
