"""SQL of what depends on the order of rows: packing, cutting, merging and choosing, each step by the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators import retrieval
from lexweave.operators.structure import MAX_CHARS, MIN_CHARS
from lexweave.plans import evidence
from lexweave.plans.rollups import table


def mmr_stored(spark: SparkSession, d: str) -> DataFrame:
    """The fused candidates that have a stored vector, chosen for relevance and diversity."""
    stored = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    found = evidence.fused(spark, d).join(stored, "doc_id")
    chosen = retrieval.in_document_order(retrieval.mmr_by_vectors(found, "item_id", "doc_id"), "item_id", "doc_id")
    return chosen.select("item_id", "doc_id", F.round("score", 9).alias("score"), "pick", "fragment")


QUERIES = {"mmr_stored": mmr_stored}

#: A long sentence ends before the last space of the limit if that lies past its half, else at the limit.
_HALF = MAX_CHARS // 2
_SPOT = f"(CASE WHEN length({{0}}) <= {MAX_CHARS} THEN length({{0}}) WHEN contains(substr({{0}}, {_HALF + 2}, {MAX_CHARS - _HALF - 1}), ' ') THEN {MAX_CHARS} - instr(reverse(substr({{0}}, {_HALF + 2}, {MAX_CHARS - _HALF - 1})), ' ') ELSE {MAX_CHARS} END)"
_REST = f"regexp_replace(substr({{0}}, {_SPOT} + 1), '^\\s+', '')"
_CHUNKS = rf"""g AS (SELECT *, row_number() OVER (PARTITION BY document ORDER BY segment) AS i FROM ({evidence.ORACLE_SQL["line_segments"]})),
 p AS (SELECT document, i, section, length(text) AS size, 0 AS grp FROM g WHERE i = 1 UNION ALL
   SELECT document, i, section, CASE WHEN new THEN len ELSE size + len END, grp + CAST(new AS INT) FROM (SELECT g.document, g.i, g.section, p.size, p.grp, length(g.text) AS len,
     g.section IS DISTINCT FROM p.section OR p.size >= {MIN_CHARS} OR p.size + length(g.text) > {MAX_CHARS} AS new FROM p JOIN g ON g.document = p.document AND g.i = p.i + 1)),
 q AS (SELECT document, grp, string_agg(text, chr(10) ORDER BY i) AS content, list(g.section ORDER BY i) FILTER (g.section <> '') AS sections, list(clause ORDER BY i) FILTER (clause <> '') AS clauses FROM p JOIN g USING (document, i) GROUP BY document, grp),
 s AS (SELECT document, grp, unnest(l) AS x, unnest(range(len(l))) AS k FROM (SELECT document, grp, string_split(regexp_replace(content, '([.;:!?])\s+([А-ЯЁA-Z0-9«"(])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS l FROM q WHERE length(content) > {MAX_CHARS})),
 u AS (SELECT document, grp, k, 0 AS j, length(x) <= {MAX_CHARS} AS whole, left(x, {_SPOT.format("x")}) AS part, {_REST.format("x")} AS rest FROM s WHERE x <> ''
   UNION ALL SELECT document, grp, k, j + 1, false, left(rest, {_SPOT.format("rest")}), {_REST.format("rest")} FROM u WHERE rest <> ''),
 n AS (SELECT *, row_number() OVER (PARTITION BY document, grp ORDER BY k, j) AS i FROM u),
 w AS (SELECT document, grp, i, length(part) AS size, 0 AS piece FROM n WHERE i = 1 UNION ALL
   SELECT document, grp, i, CASE WHEN new THEN len ELSE size + 1 + len END, piece + CAST(new AS INT) FROM (SELECT n.document, n.grp, n.i, size, piece, length(part) AS len, NOT whole OR size + 1 + length(part) > {MAX_CHARS} AS new FROM w JOIN n ON n.document = w.document AND n.grp = w.grp AND n.i = w.i + 1)),
 y AS (SELECT document, grp, piece, string_agg(part, ' ' ORDER BY i) AS content FROM w JOIN n USING (document, grp, i) GROUP BY document, grp, piece
   UNION ALL SELECT document, grp, 0, content FROM q WHERE length(content) <= {MAX_CHARS})"""
_TITLE = "nullif(left(concat_ws(' › ', sections[1], CASE WHEN len(clauses) > 1 THEN 'пп. ' || clauses[1] || '–' || clauses[-1] WHEN len(clauses) = 1 THEN 'п. ' || clauses[1] END), 255), '')"

_SHAPE = r"'(?i)^\s*(?:(?:раздел|статья|глава)\s+)?(\d{1,2}|[IVXLC]{1,6})\.?\s+([\p{L}][^\n]{2,120})$'"


def _merge_sql() -> str:
    """Two passes of the merge, each a reduction of a list of one-element lists of findings."""
    risk = lambda f: f"{f}.severity IN ('RED', 'YELLOW', 'LOW')"
    place = lambda f: f"CASE {f}.severity WHEN 'RED' THEN 0 WHEN 'YELLOW' THEN 1 WHEN 'LOW' THEN 2 WHEN 'UNKNOWN' THEN 3 WHEN 'GREEN' THEN 4 ELSE 99 END"
    share = lambda a, b: f"(CASE WHEN least(len({a}.words), len({b}.words)) > 0 THEN len(list_intersect({a}.words, {b}.words)) / least(len({a}.words), len({b}.words)) ELSE 0 END)"
    same = lambda a, b: f"coalesce({risk(a)} AND {risk(b)} AND ({share(a, b)} >= 0.7 OR coalesce({a}.key = {b}.key AND CASE WHEN contains({a}.key, '.') THEN coalesce({a}.page = {b}.page, true) ELSE {share(a, b)} >= 0.35 END, false)), false)"
    clean = lambda c: f"nullif(trim(regexp_replace(trim({c}), '(?i)^(?:пп?\\.?|раздел|статья)\\s*', '')), '')"

    def led(a: str, b: str) -> str:
        longer = f"length(coalesce({b}.quote, '')) > length(coalesce({a}.quote, ''))"
        clause = f"(CASE WHEN contains({b}.clause, '.') AND NOT contains({a}.clause, '.') THEN {b}.clause ELSE coalesce({a}.clause, {b}.clause) END)"
        bare = lambda x: f"regexp_replace(trim({x}), '[.;]+$', '')"
        fields = {
            "seq": f"{a}.seq", "severity": f"{a}.severity", "title": f"{a}.title",
            "comment": f"CASE WHEN contains({a}.comment, {b}.comment) THEN {a}.comment ELSE {a}.comment || chr(10) || chr(10) || '[Дополнительный риск: ' || {b}.title || '] ' || {b}.comment END",
            "proposal": f"CASE WHEN {a}.proposal IS NULL OR {b}.proposal IS NULL OR contains({a}.proposal, {b}.proposal) THEN coalesce({a}.proposal, {b}.proposal) ELSE {bare(a + '.proposal')} || '; ' || {bare(b + '.proposal')} || '.' END",
            "page": f"CASE WHEN {a}.page <> 0 THEN {a}.page ELSE {b}.page END", "clause": clause, "quote": f"nullif(CASE WHEN {longer} THEN {b}.quote ELSE {a}.quote END, '')",
            "verified": f"{a}.verified OR {b}.verified", "confidence": f"greatest({a}.confidence, {b}.confidence)", "merged": f"list_concat({a}.merged, {b}.merged)",
            "words": f"CASE WHEN {longer} THEN {b}.words ELSE {a}.words END", "key": clean(clause),
        }
        return "{" + ", ".join(f"'{n}': {v}" for n, v in fields.items()) + "}"

    first = f"({place('b')} < {place('a')} OR {place('b')} = {place('a')} AND -b.confidence < -a.confidence)"
    pair = f"(CASE WHEN {first} THEN {led('b', 'a')} ELSE {led('a', 'b')} END)".replace("b.", "x[1].").replace("a.", "r.")
    spot = f"list_position(list_transform(acc, lambda r: {same('r', 'x[1]')}), true)"
    step = f"list_transform([{spot}], lambda at_: CASE WHEN at_ > 0 THEN list_transform(acc, lambda r, i: CASE WHEN i = at_ THEN {pair} ELSE r END) ELSE list_concat(acc, x) END)[1]"
    merged = lambda rows: f"list_reduce(list_transform({rows}, lambda f: [f]), lambda acc, x: {step})"
    words = evidence.WORDS.replace("quote", "text")
    return rf"""WITH {evidence.BY_LINE}, k AS (SELECT doc_id AS document, line, text, CASE WHEN line % 3 = 0 THEN 'п. ' || (line % 5) || CASE WHEN line % 2 = 0 THEN '.1' ELSE '' END END AS clause FROM x),
 f AS (SELECT document, {{'seq': CAST(line AS BIGINT), 'severity': ['RED', 'YELLOW', 'LOW', 'GREEN'][line % 4 + 1], 'title': 'Rule ' || line % 7, 'comment': 'Line ' || line, 'proposal': CASE WHEN line % 2 = 0 THEN 'Change ' || line % 3 END,
   'page': CASE WHEN line % 5 > 0 THEN CAST(line % 4 AS BIGINT) END, 'clause': clause, 'quote': text, 'verified': line % 2 = 0, 'confidence': CAST(line % 10 AS DOUBLE) / 10, 'merged': [CAST(line AS BIGINT)], 'words': {words}, 'key': {clean("clause")}}} AS s FROM k),
 o AS (SELECT document, {merged("list(s ORDER BY s.seq)")} AS results FROM f GROUP BY document),
 t AS (SELECT document, {merged("results")} AS results FROM o),
 e AS (SELECT document, unnest(results) AS r FROM t)
 SELECT document, r.seq AS seq, r.severity AS severity, r.comment AS comment, r.proposal AS proposal, r.page AS page, r.clause AS clause, r.quote AS quote, r.verified AS verified, r.confidence AS confidence, array_to_string(r.merged, ',') AS merged FROM e"""


ORACLE_SQL = {
    "chunk_pack": f"""WITH RECURSIVE {_CHUNKS}
      SELECT document, row_number() OVER (PARTITION BY document ORDER BY grp, piece) - 1 AS chunk, CAST(1 AS BIGINT) AS page, CAST(1 AS BIGINT) AS page_end, {_TITLE} AS title, y.content FROM y JOIN q USING (document, grp)""",
    "page_paragraphs": f"""WITH {evidence.LINES}, a AS (SELECT document, line, trim(text) AS text, clause AS own, CASE WHEN head THEN trim(text) END AS heading FROM judged),
      b AS (SELECT *, coalesce(last_value(heading IGNORE NULLS) OVER so_far, '') AS section, coalesce(last_value(CASE WHEN heading IS NOT NULL THEN '' ELSE own END IGNORE NULLS) OVER so_far, '') AS clause,
        own IS NOT NULL OR lag(line) OVER o IS NULL OR lag(heading) OVER o IS NOT NULL AS starts FROM a WINDOW o AS (PARTITION BY document ORDER BY line), so_far AS (PARTITION BY document ORDER BY line ROWS UNBOUNDED PRECEDING)),
      c AS (SELECT *, sum(CAST(starts AS INT)) OVER (PARTITION BY document ORDER BY line ROWS UNBOUNDED PRECEDING) AS paragraph FROM b)
      SELECT document, CAST(1 AS BIGINT) AS page, section, CAST(paragraph AS BIGINT) AS paragraph, arg_min(clause, line) AS clause,
      replace(regexp_replace(string_agg(text, chr(10) ORDER BY line), '-\\n(\\p{{Ll}})', '\\1', 'g'), chr(10), ' ') AS text FROM c WHERE heading IS NULL GROUP BY document, section, paragraph""",
    "dedup_greedy": _merge_sql(),
    "mmr_stored": f"""WITH RECURSIVE {evidence.LEXICAL}, {evidence.VECTOR}, m AS (SELECT item_id, doc_id, CAST(coalesce(1.0 / (60 + vector_rank), 0) + coalesce(1.0 / (60 + lexical_rank), 0) AS DOUBLE) AS score FROM vec FULL JOIN lex USING (item_id, doc_id)),
      n AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM m),
      c AS (SELECT item_id, doc_id, score, score / max(score) OVER (PARTITION BY item_id) AS rel, v, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS i, count(*) OVER (PARTITION BY item_id) AS n FROM n JOIN e ON vec_id = doc_id WHERE place <= 12),
      s AS (SELECT a.item_id, a.i, list(round(greatest(0, least(1, coalesce(list_cosine_similarity(a.v, b.v), 0))), 9) ORDER BY b.i) AS alike FROM c a JOIN c b USING (item_id) GROUP BY a.item_id, a.i),
      r AS (SELECT DISTINCT item_id, 1 AS step, [CAST(1 AS BIGINT)] AS chosen FROM c WHERE n > {retrieval.TOP_K} UNION ALL
        SELECT item_id, step + 1, list_append(any_value(chosen), arg_max(i, (0.65 * rel - 0.35 * near - CASE WHEN near >= 0.8 THEN 2 ELSE 0 END, -i))) FROM (SELECT r.item_id, step, chosen, c.i, rel, list_max(list_transform(chosen, lambda x: alike[x])) AS near
          FROM r JOIN c ON c.item_id = r.item_id JOIN s ON s.item_id = c.item_id AND s.i = c.i WHERE NOT list_contains(chosen, c.i) AND step < {retrieval.TOP_K}) GROUP BY item_id, step),
      z AS (SELECT item_id, unnest(chosen) AS i, unnest(range(len(chosen))) AS pick FROM r WHERE step = {retrieval.TOP_K} UNION ALL SELECT item_id, i, i - 1 FROM c WHERE n <= {retrieval.TOP_K})
      SELECT item_id, doc_id, round(score, 9) AS score, pick, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS fragment FROM z JOIN c USING (item_id, i)""",
}
