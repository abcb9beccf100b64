"""Main text of web pages, with the template of a site removed.

A page is parsed into a flat list of blocks, each with the hashes of the element subtrees around it, menus and footers
included. Spark counts the subtrees for each host; one that recurs on many different pages of its host is template, and
the blocks inside it go, wherever they stand. Only single blocks inside an article are exempt, since sentences that sites
repeat in articles are text. What occurs too rarely to be counted out (an advert shown once, comments of readers, a form)
then goes by the names and class words of its elements. Where a host has too few pages to count, an article or main
element that holds most of the text stands for the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import frame, map_rows, stage, table

#: A subtree is template if it is on at least this many pages of the host, different in their texts, and on this share
#: of them: of a single line of text much more than of a menu, a footer or a box, since pages also quote one another.
MIN_PAGES = 3
MIN_SHARE = 0.01
MIN_LINE_SHARE = 0.3
#: (host, subtree) rows that are broadcast at most; about 20 bytes each. More are joined by page instead.
MAX_BROADCAST = 1_000_000
#: Stands among the subtrees of a host that has enough pages to count; no subtree has this hash but by chance.
JUDGED = -(1 << 63)

DROP = frozenset("script style noscript template svg math iframe object embed canvas audio video form button select textarea input nav header footer aside menu dialog head title".split())
RAW = frozenset("script style noscript template textarea title iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HINT = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav\w*|menus?|breadcrumbs?|sidebar|side|masthead|footer|comments?|disqus|respond|cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscribe|share|sharing|social|related|widget|pagination|pager)(?:$|[\s_-])", re.I)
#: Only outside the article: inside it, a header holds the title.
OUTER_HINT = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)
COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies|respond|disqus)(?:$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: With a single block, these are lines of text.
LINES = frozenset("p li dt dd td th blockquote pre figcaption caption h1 h2 h3 h4 h5 h6".split()) | INLINE
#: A new one of these ends an open one of the same family.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TEXT = re.compile(r"\s+")


class Block:
    """A run of text; ``named`` if an element around it goes by its name."""

    __slots__ = ("in_article", "named", "parts", "path")

    def __init__(self, path: list[Node], in_article: bool, named: bool) -> None:
        self.path, self.in_article, self.named, self.parts = path, in_article, named, []


class Node:
    __slots__ = ("article", "blocks", "digest", "dropped", "name", "prose")

    def __init__(self, name: str, dropped: bool, article: bool, prose: bool) -> None:
        self.name, self.dropped, self.article, self.prose, self.digest, self.blocks = name, dropped, article, prose, xxhash.xxh64(name.encode()), 0


def _dropped(name: str, attributes: str, article: bool) -> bool:
    if name in DROP and not (name == "header" and article):
        return True
    if attributes and name not in ("html", "body", "main"):
        for key, *values in ATTRIBUTE.findall(attributes):
            value = next((v for v in values if v), "")
            if key.lower() == "role":
                if value.lower() in ROLES:
                    return True
            elif COMMENT.search(value) or name != "article" and (HINT.search(value) or not article and OUTER_HINT.search(value)):
                return True
    return False


def parse(html: str | None) -> list[tuple[str, bool, list[int], bool]]:
    """(text, in an article or main, hashes of the countable subtrees around it, in an element that goes by its name) of
    each block, in page order.

    All subtrees count but those of a single block inside an article; scripts, styles and the like have no blocks. The
    hash of a line of text is odd, of any other subtree even. An
    element without its end tag ends with its parent, a paragraph at the next block, and a stray end tag is ignored.
    """
    html = html or ""
    stack = [Node("", False, False, False)]
    blocks: list[Block] = []
    #: One that is main text and one that is not, since an inline element may go out of the middle of a paragraph.
    open_blocks: list[Block | None] = [None, None]
    at = 0

    def text(piece: str) -> None:
        top = stack[-1]
        if open_blocks[top.dropped] is None:
            if not piece.strip():
                return
            open_blocks[top.dropped] = Block(list(stack), top.article, top.dropped)
            blocks.append(open_blocks[top.dropped])
        open_blocks[top.dropped].parts.append(piece)

    def close(node: Node) -> None:
        stack[-1].digest.update(node.digest.digest())

    while at < len(html):
        m = TOKEN.search(html, at)
        piece = html[at : m.start() if m else len(html)]
        if piece:
            stack[-1].digest.update(piece.encode(errors="replace"))
            text(piece)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name not in INLINE:
            open_blocks[:] = [None, None]
        if name == "br":
            for block in open_blocks:
                if block is not None:
                    block.parts.append(" ")
            continue
        if m[1]:
            depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d].name == name), 0)
            if depth:
                while len(stack) > depth:
                    close(stack.pop())
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name not in INLINE:  # a block ends the paragraph and the inline elements that were left open
            stop = CLOSES.get(name, {"p"})
            depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d].name in stop or stack[d].name not in INLINE), 0)
            while depth and stack[depth].name in stop:
                while len(stack) > depth:
                    close(stack.pop())
                depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d].name in stop or stack[d].name not in INLINE), 0)
        if name in VOID:
            continue
        top = stack[-1]
        node = Node(name, top.dropped or _dropped(name, m[3], top.article), top.article or name in ("article", "main"), top.prose or top.name == "article")
        node.digest.update((m[3] or "").encode(errors="replace"))
        if m[3].rstrip().endswith("/") and name in ("svg", "math"):
            continue
        stack.append(node)
    while len(stack) > 1:
        close(stack.pop())

    kept = []
    for b in blocks:
        words = _TEXT.sub(" ", unescape("".join(b.parts))).strip()
        if words:
            kept.append((words, b))
            for n in b.path:
                n.blocks += n.dropped or not b.named
    found = []
    for words, b in kept:
        counted = [n for n in b.path if n.name not in ("", "html", "body") and not (n.prose and n.blocks == 1)]
        found.append((words, b.in_article, [(n.digest.intdigest() & -2 | (n.blocks == 1 and n.name in LINES)) - (1 << 63) for n in counted], b.named))
    return found


def main_text(blocks: list[tuple[str, bool, list[int], bool]], template: set[int], judged: bool = False, names: bool = True) -> str:
    """All blocks outside the template, whatever their tags, if the host's pages were ``judged`` by counts; then without
    those that go by name, if ``names``.

    A page with nothing but template keeps its article: it is a text that the host shows in several frames. Without
    counts the blocks of article and main stand for the page if they hold at least half of its characters.
    """
    if judged:
        unlike = [(t, named) for t, _, around, named in blocks if template.isdisjoint(around)]
        if text := [t for t, named in unlike if not (names and named)]:
            return "\n\n".join(text)
    unnamed = [(t, in_article) for t, in_article, _, named in blocks if not (names and named)]
    inside = [t for t, in_article in unnamed if in_article]
    if judged:
        return "\n\n".join(inside)
    every = [t for t, _ in unnamed]
    return "\n\n".join(inside if 2 * sum(map(len, inside)) >= sum(map(len, every)) else every)


def host_of(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, min_line_share: float = MIN_LINE_SHARE) -> DataFrame:
    """(host, subtree) of the subtrees that recur on many pages of their host; a null subtree for each host with enough
    pages to judge by counts. Pages of a host with the same text are one page."""

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, contents, hashes = [], [], []
            for host, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                blocks = parse(html)
                hosts.append(host)
                # pages that differ in what goes by name only are one page
                contents.append(xxhash.xxh64("\0".join(t for t, _, _, named in blocks if not named).encode(errors="replace")).intdigest() - (1 << 63))
                hashes.append(sorted({h for _, _, around, _ in blocks for h in around}))
            yield frame({"host": (hosts, pa.string()), "content": (contents, pa.int64()), "subtrees": (hashes, pa.list_(pa.int64()))})

    seen = map_rows(pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string")), subtrees, "host string, content long, subtrees array<long>")
    # The null row counts the page. Copies of a text are one page, whatever their number.
    rows = seen.select("host", "content", F.explode(F.array_append("subtrees", F.lit(None).cast("long"))).alias("subtree")).distinct()
    counts = stage(rows.groupBy("host", "subtree").agg(F.count("*").alias("n")), "subtrees")
    sizes = counts.where("subtree IS NULL").select("host", F.col("n").alias("pages"))
    share = F.when(F.col("subtree") % 2 == 0, min_share).otherwise(min_line_share)
    enough = (F.col("n") >= min_pages) & (F.col("n") >= share * F.col("pages"))
    return counts.join(sizes, "host").where(enough).select("host", "subtree")


def extract(pages: DataFrame, max_broadcast: int = MAX_BROADCAST, names: bool = True) -> DataFrame:
    """Per page row: page_id, url, text. Without ``names`` only the counts of the host decide.

    A null or empty html has an empty text. Pages whose url is null or has no host share one nameless host. Equal rows
    stay apart and count as one page, as do pages of a host with the same text; other columns are ignored.
    """
    templates = stage(site_templates(pages), "templates")
    named = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), F.col("html").cast("string"))
    spark = pages.sparkSession
    if templates.count() <= max_broadcast:
        by_host: dict[str, set[int]] = {}
        for r in templates.toLocalIterator():
            by_host.setdefault(r["host"], set()).add(JUDGED if r["subtree"] is None else r["subtree"])
        sent = spark.sparkContext.broadcast(by_host)
        rows = named.withColumn("subtrees", F.lit(None).cast("array<long>"))
    else:
        sent = None
        lists = templates.groupBy("host").agg(F.collect_list(F.coalesce("subtree", F.lit(JUDGED))).alias("subtrees"))
        rows = named.join(lists, "host", "left")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [sent.value.get(h, ()) for h in b.column("host").to_pylist()] if sent else [set(x or ()) for x in b.column("subtrees").to_pylist()]
            texts = [main_text(parse(h), set(t), JUDGED in t, names) for h, t in zip(b.column("html").to_pylist(), own, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    id_type = dict(pages.dtypes)["page_id"]
    return map_rows(rows, take, f"page_id {id_type}, url string, text string")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
