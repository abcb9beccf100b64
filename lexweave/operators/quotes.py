"""Quotes: token normalisation, location in positioned text, strict verification, phrase search, highlight boxes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexweave.operators.asof import last_mark
from lexweave.operators.columns import let

# Characters stripped from tokens, the fuzzy threshold, lexemes of strict comparison, and negations.
STRIP = "«»\"'“”„()[]{}.,;:!?…"
FUZZY = 82
#: Tokens that the search for a clause goes back, and those of a block where it looks inside a quote.
BACK, INSIDE = 600, 64
#: Phrases of one automaton, about 1 kB each.
PHRASES = 20_000
#: Bits of one row that compares stretches of a text, 8 kB.
LANES = 1 << 16
_LETTER = r"[\p{L}\p{Nl}\p{No}]"
LEXEME = rf"[+\-−]?\p{{Nd}}+(?:[.,:/]\p{{Nd}}+)*[%‰]?|{_LETTER}+|(?U)[^\p{{L}}\p{{N}}_\s]|_"
#: A word that a hyphen cuts at the end of a line, if the rest is in lower case; a negation with a hyphen is no such word.
WRAPPED = rf"((?<!{_LETTER})(?!(?iu:без)[-\u00AD]){_LETTER}{{3,}}+)[-\u00AD][ \t]*\r?\n[ \t]*(?=\p{{Ll}})"
SOFT_HYPHEN = rf"(?<={_LETTER})\u00AD(?={_LETTER})"
#: Without such a place the joining of words across lines changes nothing.
WRAPS = r"[-\u00AD][ \t]*\r?\n[ \t]*\p{Ll}"
NEGATION = r"\n(?iu:не|ни|без)"
SIGN = r"\n[-+−±<>≤≥=]"


def normal_token(token: Column) -> Column:
    """Lower case, ё as е, no quotes or punctuation around, dashes as hyphens."""
    swap = lambda text, old, new: F.replace(text, F.lit(old), F.lit(new))
    bare = F.btrim(swap(F.lower(token), "ё", "е"), F.lit(STRIP))
    return swap(swap(bare, "–", "-"), "—", "-")


def has_norm(token: Column) -> Column:
    """Whether a token has a normal form, without making it: neither case nor letters change what is left to strip."""
    return F.btrim(token, F.lit(STRIP)) != ""


def normal_tokens(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), has_norm), normal_token)


@lru_cache(maxsize=4)
def automaton_of(needles: tuple[str, ...]):
    """One for each worker and block of phrases, as workers run many tasks."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for needle in needles:
        automaton.add_word(needle, needle)
    automaton.make_automaton()
    return automaton


def needles_in_blocks(phrases: DataFrame, phrase: str, block: int = PHRASES) -> Iterator[Broadcast]:
    """Normalised phrases with the ids that ask for them, sent to all workers in blocks of about ``block``; one block at least."""
    needles = phrases.select(phrase, F.array_join(normal_tokens(F.col("text")), " ").alias("needle")).where("needle <> ''")
    n_blocks = max(1, -(-needles.count() // block))
    for k in range(n_blocks):
        names: dict[str, list] = {}
        for r in needles.where(F.pmod(F.xxhash64("needle"), F.lit(n_blocks)) == k).toLocalIterator():
            names.setdefault(r["needle"], []).append(r[phrase])
        yield phrases.sparkSession.sparkContext.broadcast(names)


def needle_starts(automaton, text: str) -> Iterable[tuple[str, list[int]]]:
    """The needles that stand in a text, each with the places where it begins; those of one needle do not overlap."""
    starts: dict[str, list[int]] = {}
    for last, needle in automaton.iter(text):
        at, own = last + 1 - len(needle), starts.setdefault(needle, [])
        if not own or at >= own[-1] + len(needle):
            own.append(at)
    return starts.items()


def phrase_hits(rows: DataFrame, phrases: DataFrame, key: str, phrase: str, limit: int = 20, block: int = PHRASES) -> DataFrame:
    """(key, phrase, total, positions): non-overlapping occurrences of a phrase in the normalised text of a row, inside
    longer words too.

    ``rows`` and ``phrases`` have a column ``text``. The phrases are the query set: they go to all rows in blocks of at
    most ``block``, each as one automaton that reads a text once for all of them. ``positions`` are the first ``limit``
    character offsets in the normalised text; ``total`` counts all. Phrases without a token and null texts have no hits.
    """
    hay = rows.select(key, F.array_join(normal_tokens(F.col("text")), " ").alias("hay"))
    return hits_in(hay, phrases, key, phrase, limit, block)


def hits_in(hay: DataFrame, phrases: DataFrame, key: str, phrase: str, limit: int = 20, block: int = PHRASES) -> DataFrame:
    """``phrase_hits`` of rows (key, hay) whose texts are normalised already, with ``size``, the length of the phrase."""
    types = {key: dict(hay.dtypes)[key], phrase: dict(phrases.dtypes)[phrase]}
    hay = hay.select(key, "hay").where("hay <> ''")
    asked = to_arrow_type(phrases.schema[phrase].dataType)
    found = None
    for sent in needles_in_blocks(phrases, phrase, block):

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            if not sent.value:
                return
            automaton = automaton_of(tuple(sent.value))
            for batch in batches:
                out: list[tuple] = []
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    out.extend((i, p, len(own), own[:limit], len(needle)) for needle, own in needle_starts(automaton, text) for p in sent.value[needle])
                columns = list(zip(*out, strict=True)) or [()] * 5
                arrow = [batch.schema.field(0).type, asked, pa.int64(), pa.list_(pa.int64()), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow, strict=True)], names=[key, phrase, "total", "positions", "size"])

        hits = hay.mapInArrow(search, f"{key} {types[key]}, {phrase} {types[phrase]}, total long, positions array<long>, size long")
        found = hits if found is None else found.unionByName(hits)
    return found


def box_union(words: DataFrame) -> DataFrame:
    """(document, page, line, x0, y0, x1, y1): the box around the words of each line."""
    return words.groupBy("document", "page", "line").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def lexeme_line(text: Column, join_wraps: bool) -> Column:
    """The lexemes of a text, which keep case, numbers, signs and punctuation, each between line breaks.

    With ``join_wraps`` a word that a hyphen cuts at the end of a line is one lexeme.
    """
    whole = F.regexp_replace(text, WRAPPED, "$1") if join_wraps else text
    solid = F.when(F.contains(text, F.lit("\u00ad")), F.regexp_replace(whole, SOFT_HYPHEN, "")).otherwise(whole)
    return F.concat(F.lit("\n"), F.array_join(F.regexp_extract_all(solid, F.lit(LEXEME), F.lit(0)), "\n"), F.lit("\n"))


def stands_in(quote: Column, text: Column) -> Column:
    """Whether a line of lexemes stands in another one, with no negation before it and no sign before its number.

    The pattern begins with the quote itself, so that only places where it stands are looked at any further.
    """
    own = F.concat(F.lit("\\Q"), quote, F.lit("\\E"))
    bare = lambda before: F.concat(F.lit(f"(?<!{before}"), own, F.lit(")"))
    unsigned = F.when(quote.rlike(r"^\n[\p{Nd}²³¹⁰⁴-⁹₀-₉]"), bare(SIGN)).otherwise(F.lit(""))
    return F.rlike(text, F.concat(own, bare(NEGATION), unsigned))


def verify_quotes(quotes: DataFrame) -> DataFrame:
    """Rows (quote, fragment, page_text) with ``verified``: the quote stands word for word in both other texts.

    It may do so as it is written or with words joined across lines, in both texts alike. A missing part verifies
    nothing, nor does a quote without a letter or a digit. The shorter text is looked at first and the longer one only
    if the quote stands in it, equal texts once, and joined words only where a hyphen ends a line.
    """
    fragment, page = F.col("fragment"), F.col("page_text")
    both = F.when(F.octet_length(page) < F.octet_length(fragment), F.array(page, fragment)).otherwise(F.array(fragment, page))
    texts = F.when(fragment == page, F.array(fragment)).otherwise(both)
    stands = lambda join_wraps: let(lexeme_line(F.col("quote"), join_wraps), lambda q: F.forall(texts, lambda t: stands_in(q, lexeme_line(t, join_wraps))))
    wraps = F.col("quote").rlike(WRAPS) | fragment.rlike(WRAPS) | page.rlike(WRAPS)
    says = F.regexp_replace("quote", SOFT_HYPHEN, "").rlike(r"[\p{L}\p{N}]")
    return quotes.withColumn("verified", F.coalesce(says & (stands(False) | (wraps & stands(True))), F.lit(False)))


def with_page_texts(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """Quotes (document, quote_id, page, page_end, ...) with ``page_text``: the texts of these pages, in order."""
    span = quotes.select("document", "quote_id", F.explode(F.sequence("page", "page_end")).alias("page"))
    texts = span.join(pages.select("document", "page", "text"), ["document", "page"]).groupBy("document", "quote_id")
    joined = texts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n").alias("page_text"))
    return quotes.join(joined, ["document", "quote_id"], "left")


class Likeness:
    """The longest common subsequence of a quote with stretches of a text, by bit rows, and their Indel likeness."""

    def __init__(self, quote: str, text: str) -> None:
        self.quote = quote
        codes = lambda s: np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
        signs = np.unique(codes(quote))
        self.letters = {chr(c): i for i, c in enumerate(signs.tolist())}
        told = np.minimum(np.searchsorted(signs, codes(text)), len(signs) - 1)
        #: The text as numbers of the quote's characters; another character is one more than there are.
        self.codes = np.where(signs[told] == codes(text), told, len(signs)).astype(np.uint8 if len(signs) < 256 else np.uint32)

    def common(self, start: int, end: int) -> int:
        return int(self.commons(np.array([start]), np.array([end]))[0])

    def commons(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """``common`` of many stretches at once: each has a lane of the row, with a free bit for what an addition carries."""
        width = int((ends - starts).max()) // 8 + 1
        at = starts[:, None] + np.arange(8 * width)
        inside = at < ends[:, None]
        codes = np.where(inside, self.codes[np.minimum(at, len(self.codes) - 1)], len(self.letters)).reshape(-1).astype(self.codes.dtype)
        packed = np.packbits(codes == np.arange(len(self.letters), dtype=codes.dtype)[:, None], axis=1, bitorder="little")
        where = [int.from_bytes(r.tobytes(), "little") for r in packed]
        row = full = int.from_bytes(np.packbits(inside.reshape(-1), bitorder="little").tobytes(), "little")
        for c in self.quote:
            hit = row & where[self.letters[c]]
            row = ((row + hit) | (row - hit)) & full
        left = np.frombuffer(row.to_bytes(width * len(starts), "little"), np.uint8).reshape(len(starts), width)
        return ends - starts - np.bitwise_count(left).sum(axis=1, dtype=np.int64)


def seeded(quote: str, text: str, size: int = 6) -> int | None:
    """Where the quote would begin by most of its pieces that stand in the text."""
    votes: dict[int, int] = {}
    for i in range(0, len(quote) - size + 1, size):
        piece, at = quote[i : i + size], -1
        for _ in range(4):
            at = text.find(piece, at + 1)
            if at < 0:
                break
            votes[(at - i) // 8] = votes.get((at - i) // 8, 0) + 1
    return max(votes, key=lambda k: (votes[k], -k)) * 8 if votes else None


def best_stretch(quote: str, text: str, least: float = FUZZY) -> tuple[int, int, float] | None:
    """(start, end, score) of the stretch of the text most like the quote, the first of equals; None under ``least``.

    Stretches have the quote's length, or less where the text begins or ends; if the text is the shorter one, it is
    compared with stretches of the quote and found as a whole. The score is the Indel likeness, 0 to 100.

    Where most pieces of the quote point is tried first, which raises the bar. Stretches that begin near each other are
    then compared as one longer stretch, which has as much in common as any of them; those that reach the bar are parted
    and compared again, down to single ones. The score is the best of all stretches, and for a given quote the time is
    linear in the text.
    """
    if not quote or not text:
        return None
    if len(text) < len(quote):
        found = best_stretch(text, quote, least)
        return found and (0, len(text), found[2])
    m, n = len(quote), len(text)
    likeness = Likeness(quote, text)
    bounds = lambda at: (max(0, at), min(n, at + m))
    # the score 200 * common / (m + size) as a fraction; at first a bar that ``least`` itself passes
    best: tuple[int, int, int] | None = None

    def reaches(common: int, size: int, at: int) -> bool:
        if best is None:
            return 200 * common >= least * (m + size)
        left, right = common * best[1], best[0] * (m + size)
        return left > right or left == right and at < best[2]

    def try_at(common: int, at: int) -> None:
        nonlocal best
        start, end = bounds(at)
        if reaches(common, end - start, at):
            best = (common, m + end - start, at)

    guess = seeded(quote, text)
    near = np.array([] if guess is None else [at for at in range(guess, guess + 8) if -m < at < n], np.int64)
    if len(near):
        for common, at in zip(likeness.commons(np.maximum(near, 0), np.minimum(near + m, n)).tolist(), near.tolist(), strict=True):
            try_at(common, at)

    # blocks of ``step`` stretches that begin at ``low`` and after; the shortest one of a block asks for least
    step = max(1, m // 2)
    low = np.arange(1 - m, n, step, dtype=np.int64)
    while len(low):
        high = np.minimum(low + step, n) - 1
        starts, ends = np.maximum(low, 0), np.minimum(high + m, n)
        kept = []
        lanes = max(1, LANES // (m + step))
        for k in range(0, len(low), lanes):
            a, z, lo, hi = (x[k : k + lanes] for x in (starts, ends, low, high))
            shortest = np.minimum(np.minimum(lo + m, n) - np.maximum(lo, 0), np.minimum(hi + m, n) - np.maximum(hi, 0))
            most = np.minimum(z - a, m)
            bar = (least / 200 if best is None else best[0] / best[1]) * (m + shortest) - 1e-6
            open_ = np.nonzero(most >= bar)[0]
            if not len(open_):
                continue
            common = likeness.commons(a[open_], z[open_])
            taken = common >= bar[open_]
            if step == 1:
                for c, at in zip(common[taken].tolist(), lo[open_][taken].tolist(), strict=True):
                    try_at(c, at)
            else:
                kept.append(lo[open_][taken])
        if step == 1 or not kept:
            break
        inner = max(1, step // 6)
        parts = np.concatenate(kept)[:, None] + np.arange(0, step, inner)
        low, step = np.unique(parts[parts < n]), inner
    if best is None:
        return None
    start, end = bounds(best[2])
    return start, end, 200 * best[0] / best[1]


def clause_mark(token: Column, norm: Column) -> Column:
    """The clause number that a token is, '' for a section's number, else null; both count at the start of a line only."""
    section = norm.rlike(r"^\d{1,2}$") & F.endswith(token, F.lit("."))
    return F.when(section, F.lit("")).when(norm.rlike(r"^\d{1,2}(?:\.\d{1,3}){1,3}$"), norm)


def clause_of_quotes(tokens: DataFrame, quotes: DataFrame) -> DataFrame:
    """(document, quote, clause): the clause number nearest before a quote, no further back than 600 tokens or a section;
    else the first one inside the quote.

    ``tokens`` has document, position, token (as written) and starts_line; ``quotes`` has document, quote (of any type),
    first and last position. Clauses that stand before are looked up as of the quote's start; for the other quotes the
    blocks of tokens that they cover meet the clauses in these blocks.
    """
    lines = tokens.where("starts_line").withColumn("norm", normal_token(F.col("token")))
    at = F.col("position").cast("long")
    marks = lines.withColumn("mark", clause_mark(F.col("token"), F.col("norm"))).where("mark IS NOT NULL").select("document", at.alias("at"), (at + BACK - 1).alias("until"), "mark")
    asked = last_mark(quotes.select("document", "quote", F.col("first").cast("long").alias("at"), F.col("last").cast("long").alias("last")), marks)
    before = asked.where("mark <> ''").select("document", "quote", F.col("mark").alias("clause"))
    covered = F.sequence(F.floor(F.col("at") / INSIDE), F.floor(F.col("last") / INSIDE))
    open_quotes = asked.where("coalesce(mark, '') = ''").select("document", "quote", F.col("at").alias("first"), "last", F.explode(covered).alias("block"))
    blocks = marks.where("mark <> ''").select("document", "at", "mark", F.floor(F.col("at") / INSIDE).alias("block"))
    inside = open_quotes.join(blocks, ["document", "block"], "left").withColumn("mark", F.when(F.col("at").between(F.col("first"), F.col("last")), F.col("mark")))
    return before.unionByName(inside.groupBy("document", "quote").agg(F.min_by("mark", F.when(F.col("mark").isNotNull(), F.col("at"))).alias("clause")))
