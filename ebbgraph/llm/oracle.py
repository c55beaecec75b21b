"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

OP1 = r"""
WITH lines AS (
  SELECT doc_id, n - 1 AS n, trim(l[n], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line,
         len(regexp_extract_all(l[n], '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), unnest(generate_series(1, len(l))) AS u(n)
), full_lines AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY n) AS total FROM lines WHERE words > 0
), ends AS (
  SELECT a.doc_id, a.n AS first, min(b.n) AS last
  FROM full_lines a JOIN full_lines b ON a.doc_id = b.doc_id AND b.n >= a.n AND b.total - a.total + a.words >= 50
  GROUP BY a.doc_id, a.n
), windows AS (
  SELECT e.doc_id, first, last, string_agg(line, chr(10) ORDER BY n) AS content
  FROM ends e JOIN full_lines f ON e.doc_id = f.doc_id AND n BETWEEN first AND last GROUP BY ALL
), later AS (
  SELECT doc_id, first, last FROM windows
  QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id, first) > 1
), gone AS (
  SELECT DISTINCT l.doc_id, n FROM lines l JOIN later w ON l.doc_id = w.doc_id AND n BETWEEN first AND last
), numbered AS (
  SELECT doc_id, n, l[n + 1] AS raw
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), unnest(generate_series(0, len(l) - 1)) AS u(n)
), kept AS (
  SELECT a.doc_id, a.n, raw, g.n IS NOT NULL AS deleted FROM numbered a LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.n = g.n
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (deleted) AS n_deleted,
       coalesce(string_agg(raw, chr(10) ORDER BY n) FILTER (NOT deleted), '') AS text
FROM kept GROUP BY doc_id
"""

#: Repeated runs go to their last line: runs that start at a line or end at it, each with the fewest lines that make 50 words.
OP1_WHOLE_RUNS = OP1.replace("), windows AS (", """
  UNION
  SELECT a.doc_id, max(b.n) AS first, a.n AS last
  FROM full_lines a JOIN full_lines b ON a.doc_id = b.doc_id AND b.n <= a.n AND a.total - b.total + b.words >= 50
  GROUP BY a.doc_id, a.n
  UNION
  SELECT doc_id, n, next FROM (
    SELECT *, lead(n) OVER w AS next, lead(words) OVER w AS next_words FROM full_lines WINDOW w AS (PARTITION BY doc_id ORDER BY n)
  ) WHERE words >= 50 AND next_words >= 50
), windows AS (""")

#: The given pages all mark their text as an article of headings and paragraphs, so SQL can cut it out.
OP3 = r"""
WITH inside AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS article FROM pages
), blocks AS (
  SELECT page_id, n, regexp_replace(b[n], '<[^>]*>', ' ', 'g') AS block
  FROM (SELECT page_id, string_split_regex(article, '</?(?:p|h1)>') AS b FROM inside), unnest(generate_series(1, len(b))) AS u(n)
), decoded AS (
  SELECT page_id, n, trim(regexp_replace(replace(replace(regexp_replace(block, '&amp;?', chr(1), 'g'), '&quot;', '"'), chr(1), '&'), '\s+', ' ', 'g')) AS line
  FROM blocks
), texts AS (
  SELECT page_id, string_agg(line, chr(10) ORDER BY n) AS text FROM decoded WHERE line <> '' GROUP BY page_id
)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars
FROM inside LEFT JOIN texts USING (page_id)
"""

OP5 = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

OP9 = r"""
WITH lowered AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), words AS (
  SELECT kind, id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM lowered
), items AS (
  SELECT id AS item_id, w, least(13, len(w)) AS n FROM words WHERE kind = 'b' AND len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS gram
  FROM items, unnest(generate_series(1, len(w) - n + 1)) AS u(s)
), lengths AS (
  SELECT DISTINCT n FROM windows
), places AS (
  SELECT id AS doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS gram
  FROM words, lengths, unnest(generate_series(1, len(w) - n + 1)) AS u(s)
  WHERE kind = 'd' AND len(w) >= n
), hits AS (
  SELECT doc_id, item_id, s, p.n FROM places p JOIN windows USING (gram)
  WHERE p.n = windows.n
), covered AS (
  SELECT doc_id, count(DISTINCT s + k) AS n_hit
  FROM hits, unnest(generate_series(0, n - 1)) AS u(k) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN covered c ON c.doc_id = id LEFT JOIN listed l ON l.doc_id = id
WHERE kind = 'd'
"""

OP7 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), placed AS (
  SELECT *, row_number() OVER w AS place, lag(role) OVER w IS DISTINCT FROM role AS opens, lead(role) OVER w IS DISTINCT FROM role AS closes
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(CASE WHEN opens THEN length('<turn >') + length(role) + length(regexp_replace(role, '[^<>\\]', '', 'g')) ELSE 0 END
           + length(text) + length(regexp_replace(text, '[^<>\\]', '', 'g'))
           + CASE WHEN closes THEN length('</turn>') ELSE length('<next>') END)::BIGINT AS formatted_chars
FROM placed GROUP BY conv_id
"""

OP11 = r"""
WITH lowered AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), words AS (
  SELECT kind, id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM lowered
), sizes AS (
  SELECT count(*) FILTER (len(w) > 0)::BIGINT AS n_docs, greatest(1, sum(len(w)))::BIGINT AS total FROM words WHERE kind = 'd'
), item_terms AS (
  SELECT DISTINCT id AS item_id, unnest(w) AS term FROM words WHERE kind = 'b'
), counted AS (
  SELECT doc_id, n, term, count(*) AS tf
  FROM (SELECT id AS doc_id, len(w) AS n, unnest(w) AS term FROM words WHERE kind = 'd') GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight
  FROM counted, sizes GROUP BY term, n_docs
), scored AS (
  SELECT item_id, doc_id,
         sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // total))))::BIGINT AS score
  FROM item_terms JOIN counted USING (term) JOIN weights USING (term), sizes GROUP BY item_id, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""

OP12 = r"""
WITH RECURSIVE chars AS (
  SELECT doc_id, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT) AS codes FROM documents WHERE doc_id IS NOT NULL
), crc AS (
  SELECT doc_id, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], codes), lambda acc, code:
    list_reduce([xor(acc, code), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1))))) AS value
  FROM chars
), fields AS (
  SELECT d.doc_id, source, text, coalesce(value % 5 = 0, false) AS chosen,
         coalesce(strlen(d.doc_id::VARCHAR) || ':' || d.doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
  FROM documents d LEFT JOIN crc USING (doc_id)
), leaves AS (
  SELECT doc_id, source, chosen, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS changed
  FROM fields
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM leaves
), nodes(source, level, place, h, n) AS (
  SELECT source, 0, place, leaf, n FROM placed
  UNION ALL
  SELECT source, level + 1, place // 16, sha256(string_agg(h, '' ORDER BY place)), (n + 15) // 16
  FROM nodes WHERE n > 1 GROUP BY source, level, place // 16, n
), subroots AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops(level, place, h, n) AS (
  SELECT 0, place, subroot, n FROM subroots
  UNION ALL
  SELECT level + 1, place // 16, sha256(string_agg(h, '' ORDER BY place)), (n + 15) // 16
  FROM tops WHERE n > 1 GROUP BY level, place // 16, n
), runs AS (
  SELECT source, level, place // 16 AS run, list(h ORDER BY place) AS hs FROM nodes WHERE n > 1 GROUP BY ALL
), top_runs AS (
  SELECT level, place // 16 AS run, list(h ORDER BY place) AS hs FROM tops WHERE n > 1 GROUP BY ALL
), steps AS (
  SELECT p.doc_id, p.leaf, r.level, (p.place // (16 ** r.level)::BIGINT) % 16 AS digit, hs
  FROM placed p JOIN runs r ON p.source IS NOT DISTINCT FROM r.source AND r.run = p.place // (16 ** (r.level + 1))::BIGINT
  UNION ALL
  SELECT p.doc_id, p.leaf, 100 + r.level, (s.place // (16 ** r.level)::BIGINT) % 16, hs
  FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source JOIN top_runs r ON r.run = s.place // (16 ** (r.level + 1))::BIGINT
), paths AS (
  SELECT doc_id, leaf, list({'l': array_to_string(hs[1 : digit], ''), 'r': array_to_string(hs[digit + 2 :], '')} ORDER BY level) AS path
  FROM steps GROUP BY doc_id, leaf
), folded AS (
  SELECT p.doc_id, p.leaf, p.source, coalesce(path, []) AS path,
         CASE WHEN chosen THEN changed ELSE p.leaf END AS start
  FROM placed p LEFT JOIN paths t ON p.doc_id = t.doc_id AND p.leaf = t.leaf
), folding(doc_id, leaf, source, path, i, h) AS (
  SELECT doc_id, leaf, source, path, 0, start FROM folded
  UNION ALL
  SELECT doc_id, leaf, source, path, i + 1, sha256(path[i + 1].l || h || path[i + 1].r) FROM folding WHERE i < len(path)
)
SELECT f.doc_id, f.leaf, subroot, (SELECT h FROM tops WHERE n = 1) AS root,
       sha256(array_to_string(list_transform(path, lambda x: x.l || x.r), '')) AS proof_sha256,
       f.h AS folded_root, f.h = (SELECT h FROM tops WHERE n = 1) AS verified
FROM folding f JOIN subroots s ON f.source IS NOT DISTINCT FROM s.source WHERE i = len(path)
"""

OP13 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[s : s + 3], ' ') AS gram
  FROM words, unnest(generate_series(1, greatest(1, len(w) - 3))) AS u(s) WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM shingles a JOIN shingles b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)
), reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, b FROM reached r JOIN links ON r.other = a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) LEFT JOIN sizes USING (doc_id)
"""

ORACLE: dict[str, str] = {
    "op1_line_dedup": OP1, "op1_line_dedup_whole_runs": OP1_WHOLE_RUNS, "op3_html_extraction": OP3, "op5_exact_dedup": OP5, "op7_chat_formatting": OP7, "op9_benchmark_decontamination": OP9,
    "op11_ranked_search": OP11, "op12_merkle_manifest": OP12, "op13_jaccard_join": OP13,
}
