"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

# The CRC-32 of an ASCII text, bit by bit; 3988292384 is its polynomial.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)),
    lambda acc, byte: list_reduce(list_prepend(xor(acc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda s, z: xor(s >> 1, (s & 1) * 3988292384))))"""

OP11 = f"""
WITH own AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT conv_id, conv_id - conv_id % 100 AS base, {CRC32.format(text="conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM own)
), turns AS (
    SELECT c.conv_id, o.pos, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.base AND o.pos <= c.h
    UNION ALL
    SELECT c.conv_id, o.pos, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h
), paths AS (
    SELECT c.conv_id, count(t.pos) AS len, coalesce(list({{'role': t.role, 'text': t.text}} ORDER BY t.pos) FILTER (t.pos IS NOT NULL), []) AS path
    FROM convs c LEFT JOIN turns t USING (conv_id) GROUP BY c.conv_id
), members AS (
    SELECT conv_id, len, d.d AS depth, md5(list_slice(path, 1, d.d)::VARCHAR) AS node, CASE WHEN d.d > 0 THEN md5(list_slice(path, 1, d.d - 1)::VARCHAR) END AS up,
        CASE WHEN d.d > 0 THEN length(path[d.d].text) ELSE 0 END AS chars, path
    FROM paths, LATERAL (SELECT unnest(range(0, len + 1)) AS d) d
), nodes AS (
    SELECT node, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, any_value(path) AS path,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len = depth), '')) AS ends_sha256
    FROM members GROUP BY node, depth
), children AS (
    SELECT up AS node, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), sized AS (
    SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (node, depth)
), subtrees AS (
    SELECT md5(list_slice(path, 1, a.a)::VARCHAR) AS node, a.a AS depth, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens
    FROM sized, LATERAL (SELECT unnest(range(0, depth + 1)) AS a) a GROUP BY ALL
)
SELECT s.conv_id, s.depth, p.conv_id AS parent_conv_id, s.n_convs, s.n_children, t.n_leaves::BIGINT AS n_leaves, t.saved_tokens::BIGINT AS saved_tokens, s.ends_sha256
FROM sized s JOIN subtrees t USING (node, depth) LEFT JOIN sized p ON p.node = s.up AND p.depth = s.depth - 1
"""

OP13 = """
WITH docs AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
    FROM documents
), occurs AS (
    SELECT doc, lang, source, unnest(terms) AS term FROM docs
), kept AS (
    SELECT lang, term FROM occurs GROUP BY ALL HAVING count(DISTINCT doc) >= 3
), counts AS (
    SELECT lang, source, term, count(*) AS n FROM occurs JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
    SELECT DISTINCT lang, source FROM docs
), sizes AS (
    SELECT lang, count(*) AS v FROM kept GROUP BY lang
), totals AS (
    SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM groups g LEFT JOIN counts c USING (lang, source) GROUP BY ALL
), shares AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + s.v) AS p
    FROM totals g JOIN sizes s USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), lang_shares AS (
    SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (sum(sum(n)) OVER (PARTITION BY lang) + any_value(v)) AS q
    FROM counts JOIN sizes USING (lang) GROUP BY lang, term
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), terms AS (
    SELECT s.lang, s.source, s.term AS item, (p - q) * (p - q) // q AS value FROM shares s JOIN lang_shares l ON l.lang = s.lang AND l.term = s.term WHERE n > 0 AND p > q
), found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL SELECT lang, source, 'term', item, value FROM terms
), ranked AS (
    SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""

OP12 = """
WITH RECURSIVE words AS (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
    SELECT row, doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), shingles AS (
    SELECT row, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
    SELECT a.row AS a, b.row AS b FROM shingles a JOIN shingles b ON a.shingle = b.shingle
    GROUP BY a.row, b.row, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(a, b) AS (
    SELECT row, row FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT s.doc_id, any_value(len(s.s)) AS n_shingles, min(o.doc_id) AS component_id, s.doc_id = min(o.doc_id) AS kept
FROM sets s JOIN reach r ON r.a = s.row JOIN sets o ON o.row = r.b GROUP BY s.row, s.doc_id
"""
