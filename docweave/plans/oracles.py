"""SQL for the queries whose results SQL reaches by another way: recursion instead of folds, visibility instead of a stack.

Each text is the ``WITH`` part of a DuckDB query over the driver tables.
"""

from __future__ import annotations

#: White space at the ends of texts, as a SQL string.
WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"


def prose(x: str) -> str:
    return f"trim(regexp_replace({x}, '[ \\t\\r\\n]+', ' ', 'g'), {WHITE})"


# Markdown: the rows of as_markdown, line by line.
MARKDOWN = f"""
md AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i = 1 THEN '# ' WHEN (i - 1) % 4 = 0 THEN repeat('#', CAST((i - 1) // 4 % 3 + 2 AS INT)) || ' ' WHEN (i - 1) % 7 = 3 THEN '- ' ELSE '' END
  || x || CASE WHEN (i - 1) % 4 = 0 THEN chr(10) ELSE '' END), chr(10)) || chr(10) || chr(10) || '```py' || chr(10) || 'x = 1' || chr(10) || chr(10) || 'y = 2' || chr(10) || '```' || chr(10) AS raw FROM documents WHERE text IS NOT NULL),
ml AS (SELECT doc_id, unnest(string_split(regexp_replace(raw, '\\r\\n?', chr(10), 'g'), chr(10))) AS t, generate_subscripts(string_split(regexp_replace(raw, '\\r\\n?', chr(10), 'g'), chr(10)), 1) - 1 AS line FROM md),
mf AS (SELECT *, regexp_matches(t, '^\\s*```') AS fence, count(*) FILTER (regexp_matches(t, '^\\s*```')) OVER (PARTITION BY doc_id ORDER BY line) AS fences FROM ml),
mk AS (SELECT *, CASE WHEN fence THEN 'fence' WHEN fences % 2 = 1 THEN 'code' WHEN regexp_matches(t, '^#{{1,6}}\\s+\\S') THEN 'heading' WHEN regexp_matches(t, '^\\s*(?:[-*+]|[0-9]+[.)])\\s+\\S') THEN 'list'
  WHEN regexp_matches(t, '^\\s*>') THEN 'quote' WHEN trim(t, {WHITE}) = '' THEN 'blank' ELSE 'text' END AS kind FROM mf),
mr AS (SELECT *, sum(CASE WHEN kind IN ('heading', 'list', 'blank', 'fence') OR kind IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS run
  FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line) AS before FROM mk)),
mg AS (SELECT doc_id, run, kind, min(line) AS pos, string_agg(t, chr(10) ORDER BY line) AS raw FROM mr WHERE kind NOT IN ('blank', 'fence') GROUP BY ALL),
mi AS (SELECT doc_id, CAST(pos AS INT) AS pos, CASE WHEN kind IN ('heading', 'code') THEN kind ELSE 'text' END AS kind, CASE WHEN kind = 'heading' THEN CAST(length(regexp_extract(raw, '^#+')) AS INT) END AS depth,
  CASE kind WHEN 'heading' THEN {prose("regexp_replace(regexp_replace(raw, '^#{1,6}\\s+', ''), '\\s+#+\\s*$', '')")} WHEN 'code' THEN regexp_replace(raw, '\\s+$', '')
    WHEN 'list' THEN CASE WHEN regexp_matches(raw, '^\\s*[0-9]') THEN regexp_extract(raw, '^\\s*([0-9]+)', 1) || '. ' ELSE '- ' END || {prose("regexp_replace(raw, '^\\s*(?:[-*+]|[0-9]+[.)])\\s+', '')")}
    WHEN 'quote' THEN '> ' || {prose("regexp_replace(raw, '(?m)^\\s*>\\s?', '', 'g')")} ELSE {prose('raw')} END AS text,
  CASE WHEN kind = 'code' THEN 'py' END AS language FROM mg),
items AS (SELECT doc_id, pos, kind, depth, text, language FROM (SELECT *, lag(kind) OVER w AS k, lag(text) OVER w AS x FROM mi WHERE text <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
  WHERE trim(text, {WHITE}) <> '' AND NOT coalesce(kind = 'text' AND k = 'text' AND x = text, false))
"""

# Sections: a heading is in the path of a later one if no heading between them, the later one included, is at its level or above.
SECTIONS = f"""{MARKDOWN},
heads AS (SELECT * FROM (SELECT doc_id, pos, text, greatest(1, depth - 1) AS level, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM items WHERE kind = 'heading') WHERE nth > 1),
paths AS (SELECT m.doc_id, m.pos, string_agg(h.text, ' > ' ORDER BY h.pos) AS heading_path FROM heads m JOIN heads h ON h.doc_id = m.doc_id AND h.pos <= m.pos
  WHERE NOT EXISTS (SELECT 1 FROM heads g WHERE g.doc_id = m.doc_id AND g.pos > h.pos AND g.pos <= m.pos AND g.level <= h.level) GROUP BY ALL),
bodies AS (SELECT i.doc_id, i.pos, (SELECT max(h.pos) FROM heads h WHERE h.doc_id = i.doc_id AND h.pos <= i.pos) AS head FROM items i WHERE kind <> 'heading'),
counted AS (SELECT doc_id, head, count(*) AS n_blocks FROM bodies GROUP BY ALL),
numbered AS (SELECT doc_id, head, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(head, -1)) - 1 AS INT) AS section_order FROM counted),
sections AS (SELECT c.doc_id, CAST(row_number() OVER (PARTITION BY c.doc_id ORDER BY coalesce(c.head, -1)) - 1 AS INT) AS section_order, h.text AS heading, coalesce(heading_path, '') AS heading_path, CAST(NULL AS VARCHAR) AS anchor, n_blocks
  FROM counted c LEFT JOIN heads h ON h.doc_id = c.doc_id AND h.pos = c.head LEFT JOIN paths p ON p.doc_id = c.doc_id AND p.pos = c.head)
"""

# Pages: a token for each tag and each text between tags; a block is what follows its tag up to the next tag that ends one.
DECODED = "replace(replace(replace(replace(replace(replace(replace({}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&')"
DROPPED = "|".join(["<!--.*?-->", *(f"<{t}\\b.*?</{t}\\s*>" for t in ("script", "style", "svg", "video", "audio", "noscript"))])
HTML = f"""
hp AS (SELECT page_id AS doc_id, regexp_replace(coalesce(html, ''), '(?is){DROPPED}', ' ', 'g') AS plain FROM pages),
ht AS (SELECT doc_id, unnest(regexp_extract_all(plain, '<[^>]*>|[^<]+|<')) AS t, generate_subscripts(regexp_extract_all(plain, '<[^>]*>|[^<]+|<'), 1) AS i FROM hp),
hb AS (SELECT *, regexp_extract(lower(t), '^<(h[1-6]|p|li|pre|blockquote)[^a-z0-9]', 1) AS tag,
  regexp_matches(lower(t), '^<(h[1-6]|p|li|pre|blockquote|div|section|article|nav|ul|ol|footer)[^a-z0-9]|^</(h[1-6]|p|li|pre|blockquote|div|section|article|nav|ul|ol|footer|body)[^a-z0-9]') AS border FROM ht),
hg AS (SELECT *, sum(CASE WHEN border THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM hb),
hi AS (SELECT doc_id, block, max(tag) AS tag, max(CASE WHEN tag <> '' THEN regexp_extract(t, '(?i)\\bid=["'']([^"'']+)', 1) END) AS anchor, coalesce(string_agg(CASE WHEN border THEN '' WHEN t LIKE '<%>' THEN ' ' ELSE t END, '' ORDER BY i), '') AS inner_text FROM hg GROUP BY ALL HAVING max(tag) <> ''),
hn AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1 AS INT) AS pos, tag, anchor, {prose(DECODED.format('inner_text'))} AS said FROM hi),
page_items AS (SELECT doc_id, pos, CASE WHEN tag LIKE 'h%' THEN 'heading' WHEN tag = 'pre' THEN 'code' ELSE 'text' END AS kind, CASE WHEN tag LIKE 'h%' THEN CAST(substr(tag, 2) AS INT) END AS depth,
  CASE tag WHEN 'li' THEN '- ' WHEN 'blockquote' THEN '> ' ELSE '' END || said AS text, CAST(NULL AS VARCHAR) AS language, nullif(anchor, '') AS anchor FROM hn WHERE said <> ''),
page_blocks AS (SELECT doc_id, pos, kind, depth, text, language, anchor FROM (SELECT *, lag(kind) OVER w AS k, lag(text) OVER w AS x FROM page_items WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
  WHERE NOT coalesce(kind = 'text' AND k = 'text' AND x = text, false)),
page_heads AS (SELECT page_id AS doc_id, nullif({prose(DECODED.format("regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1), '<[^>]*>', ' ', 'g')"))}, '') AS head_title FROM pages)
"""

LAST_BREAK = "greatest(CASE WHEN contains(c, ' ') THEN length(c) - strpos(reverse(c), ' ') ELSE -1 END, CASE WHEN contains(c, chr(10)) THEN length(c) - strpos(reverse(c), chr(10)) ELSE -1 END)"


def split_sql(name: str, rows: str, keys: str) -> str:
    """A recursive table of the parts of texts: keys, part (from 1), content."""
    return f"""{name} AS (
  SELECT {keys}, 0 AS part, CAST(NULL AS VARCHAR) AS content, trim(text, {WHITE}) AS rest FROM {rows}
  UNION ALL
  SELECT {keys}, part + 1, CASE WHEN length(rest) > 1800 THEN trim(substr(rest, 1, e), {WHITE}) ELSE rest END, CASE WHEN length(rest) > 1800 THEN trim(substr(rest, e + 1), {WHITE}) ELSE '' END
  FROM (SELECT {keys}, part, rest, CASE WHEN {LAST_BREAK} >= 990 THEN {LAST_BREAK} + 1 ELSE 1800 END AS e FROM (SELECT *, substr(rest, 1, 1800) AS c FROM {name} WHERE rest <> '')))"""


# Chunks: one unit of every document at a step, the units held as a list.
J = "chr(10) || chr(10)"
WHOLE_TAIL = f"coalesce(list_max(list_filter(range(1, len(held) + 1), lambda k: length(array_to_string(held[len(held) - k + 1:], {J})) <= 240)), 0)"
SUFFIX = f"trim(CASE WHEN contains(right(held[-1], 240), ' ') THEN substr(right(held[-1], 240), strpos(right(held[-1], 240), ' ') + 1) ELSE right(held[-1], 240) END, {WHITE})"


LINES = "tl AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS block_no FROM documents)"


def packed_sql(toks_of_content: str, blocks: str = LINES) -> str:
    """Chunks of the text blocks tl (doc_id, block_no, text); a code block may only be its document's last."""
    return f"""
{blocks},
{split_sql("tp", "tl", "doc_id, block_no")},
units AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block_no, part) AS i, content AS u FROM tp WHERE part > 0),
walk AS (
  SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS held, CAST(NULL AS VARCHAR) AS done FROM units
  UNION ALL
  SELECT doc_id, i, CASE WHEN NOT over THEN list_append(held, u) WHEN length(array_to_string(list_append(tail, u), {J})) > 1800 THEN [u] ELSE list_append(tail, u) END, CASE WHEN over THEN array_to_string(held, {J}) END
  FROM (SELECT *, CASE WHEN NOT over THEN CAST([] AS VARCHAR[]) WHEN whole > 0 THEN held[len(held) - whole + 1:] WHEN {SUFFIX} <> '' THEN [{SUFFIX}] ELSE CAST([] AS VARCHAR[]) END AS tail
    FROM (SELECT w.doc_id, units.i, held, u, len(held) > 0 AND length(array_to_string(list_append(held, u), {J})) > 1800 AS over, {WHOLE_TAIL} AS whole
      FROM walk w JOIN units ON units.doc_id = w.doc_id AND units.i = w.i + 1))
),
made AS (SELECT doc_id, i, done AS content FROM walk WHERE done IS NOT NULL UNION ALL (SELECT doc_id, max(i) + 1, array_to_string(arg_max(held, i), {J}) FROM walk GROUP BY doc_id)),
ordered AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS chunk_order, content FROM made),
packed AS (SELECT doc_id, chunk_order, content, 'chunk_' || substr(sha256('chunk' || chr(0) || array_to_string(list_transform([CAST(doc_id AS VARCHAR), '', CAST(chunk_order AS VARCHAR), sha256(content)], lambda p: strlen(p) || ':' || p), '')), 1, 24) AS chunk_id,
  CAST(greatest(1, ceil(length(content) / 4e0), ceil(len({toks_of_content}) * 1.3e0)) AS INT) AS estimated_tokens FROM ordered)
"""


#: The walk over ``ranked`` (question_id, rank, chunk_id): one rank of every open question at a step.
SUPPRESSED = """
pairs AS (SELECT a.body_hash AS a, b.body_hash AS b FROM (SELECT * FROM c WHERE len(t) >= 20) a JOIN (SELECT * FROM c WHERE len(t) >= 20) b ON a.body_hash <> b.body_hash AND least(a.chars, b.chars) >= greatest(a.chars, b.chars) * 0.85e0
  AND least(len(a.t), len(b.t)) >= greatest(len(a.t), len(b.t)) * 0.95e0 WHERE len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) >= 0.95e0),
alike AS (SELECT body_hash, list_append(coalesce((SELECT list(b) FROM pairs WHERE a = body_hash), []), body_hash) AS others FROM c),
bodies AS (SELECT f.doc_id AS chunk_id, sha256(body) AS body_hash FROM f),
steps AS (SELECT question_id, rank, r.chunk_id, body_hash, coalesce(others, []) AS others FROM ranked r JOIN bodies USING (chunk_id) LEFT JOIN alike USING (body_hash)),
walk AS (
  SELECT DISTINCT question_id, CAST(0 AS BIGINT) AS rank, CAST([] AS BIGINT[]) AS kept, CAST([] AS VARCHAR[]) AS hashes FROM steps
  UNION ALL
  SELECT question_id, s.rank, CASE WHEN fresh THEN list_append(kept, s.chunk_id) ELSE kept END, CASE WHEN fresh THEN list_append(hashes, body_hash) ELSE hashes END
  FROM (SELECT w.question_id, s.rank, s.chunk_id, s.body_hash, kept, hashes, NOT list_has_any(others, hashes) AS fresh FROM walk w JOIN steps s ON s.question_id = w.question_id AND s.rank = w.rank + 1 WHERE len(kept) < 10) s
),
last AS (SELECT question_id, arg_max(kept, rank) AS kept FROM walk GROUP BY question_id),
kept AS (SELECT question_id, unnest(kept) AS chunk_id, CAST(generate_subscripts(kept, 1) AS INT) AS rank FROM last)
"""

#: Contexts of ``shown`` (question_id, rank from 1, title, url, content): one match of every question at a step.
CONTEXTS = f"""
walk AS (
  SELECT DISTINCT question_id, CAST(0 AS BIGINT) AS rank, CAST([] AS VARCHAR[]) AS held, CAST([] AS VARCHAR[]) AS said FROM shown
  UNION ALL
  SELECT question_id, rank, CASE WHEN ok THEN list_append(held, body) ELSE held END, CASE WHEN ok THEN list_append(said, item) ELSE said END
  FROM (SELECT *, body <> '' AND NOT list_contains(held, body) AND length(array_to_string(list_append(said, item), ',')) + 2 <= 12000 AS ok
    FROM (SELECT w.question_id, s.rank, held, said, trim(content, {WHITE}) AS body,
      '{{"citation":' || (len(said) + 1) || ',"title":' || to_json(title) || ',"section":null,"officialUrl":' || to_json(url) || ',"content":' || to_json(content) || '}}' AS item
      FROM walk w JOIN shown s ON s.question_id = w.question_id AND s.rank = w.rank + 1))
),
contexts AS (SELECT question_id, '[' || array_to_string(arg_max(said, rank), ',') || ']' AS formatted FROM walk GROUP BY question_id)
"""
