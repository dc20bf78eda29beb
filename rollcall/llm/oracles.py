"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

NORMALISED = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

op3_exact_dedup = f"""
WITH d AS (SELECT doc_id, sha256({NORMALISED}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM d JOIN g USING (text_sha256)
"""

op6_mix_sources = """
WITH n AS (SELECT source, count(*) AS c FROM documents GROUP BY 1),
m AS (SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM n) * (SELECT sum(c) FROM n) / c AS whole FROM n),
r AS (SELECT source, ceil(whole / 64)::BIGINT AS parts, whole / ceil(whole / 64)::BIGINT AS mean FROM m),
p AS (
  SELECT source, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS below
  FROM r, (SELECT unnest(range(0, 400)) AS k)
),
d AS (
  SELECT d.*, part, ('0x' || left(md5('17:' || doc_id || CASE WHEN parts > 1 THEN ':' || part ELSE '' END), 13))::BIGINT / 4503599627370496.0::DOUBLE AS at
  FROM (SELECT d.*, parts, unnest(range(0, parts)) AS part FROM documents d JOIN r ON r.source = d.source) d
),
e AS (
  SELECT d.doc_id, any_value(d.text) AS text, any_value(d.lang) AS lang, d.source, any_value(d.n_chars) AS n_chars, count(*) AS n_copies
  FROM d JOIN p ON d.source = p.source AND p.below < d.at GROUP BY d.doc_id, d.source
)
SELECT doc_id, text, lang, source, n_chars, n_copies, copy_index,
       left(md5('17 order:' || doc_id || ':' || copy_index), 16) AS mix_key
FROM (SELECT *, unnest(range(0, n_copies)) AS copy_index FROM e)
"""

op9_warc = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT payload_digest, payload_bytes, max(page_id) AS first FROM d WHERE payload_bytes >= 1000 GROUP BY 1, 2)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN g USING (payload_digest, payload_bytes)
"""

op8_near_dedup = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
),
s AS MATERIALIZED (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END)) AS shingle FROM w
),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2
),
e AS MATERIALIZED (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 85 * (na.n + nb.n - common)
),
e2 AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS reached FROM documents UNION SELECT r.id, e2.b FROM r JOIN e2 ON e2.a = r.reached),
c AS (SELECT id, min(reached) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

op10_window_dedup = r"""
WITH w AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
),
p AS MATERIALIZED (
  SELECT doc_id, i AS pos, array_to_string(words[i:i + 19], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w)
),
l AS MATERIALIZED (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS k FROM p) WHERE k > 1
),
c AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS i FROM l),
g AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY 1),
k AS (
  SELECT w.doc_id, len(words) AS n_words, len(coalesce(gone, [])) AS n_removed,
         list_filter(words, lambda x, i: NOT list_contains(coalesce(gone, []), i)) AS kept
  FROM w LEFT JOIN g ON g.doc_id = w.doc_id
)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""


op11_conversation_trie = """
WITH t AS (
  SELECT conv_id, md5(len(role) || ':' || role || text) AS item, len(text) AS size,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(len(role) || ':' || role || text)) - 1 AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
),
c AS (SELECT conv_id, list(item ORDER BY pos) AS items, list(size ORDER BY pos) AS sizes FROM t GROUP BY 1),
h AS (
  SELECT conv_id, items, sizes, conv_id - conv_id % 100 AS head, (xor(list_reduce(
    flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END,
    4294967295::BIGINT), 4294967295) % 6)::BIGINT AS h FROM c
),
r AS MATERIALIZED (
  SELECT h.conv_id, coalesce(b.items[1:h.h], []) || h.items[h.h + 1:] AS items, coalesce(b.sizes[1:h.h], []) || h.sizes[h.h + 1:] AS sizes
  FROM h LEFT JOIN c b ON b.conv_id = h.head
),
p AS MATERIALIZED (
  SELECT conv_id, len(items) AS n, d AS depth, array_to_string(items[1:d], ',') AS path,
         CASE WHEN d = 0 THEN NULL ELSE array_to_string(items[1:d - 1], ',') END AS above, CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS size
  FROM (SELECT conv_id, items, sizes, unnest(range(0, len(items) + 1)) AS d FROM r)
),
n AS MATERIALIZED (
  SELECT depth, path, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM p GROUP BY 1, 2
),
k AS MATERIALIZED (
  SELECT n.*, coalesce(w.ways, 0) AS n_children
  FROM n LEFT JOIN (SELECT depth - 1 AS depth, above AS path, count(*) AS ways FROM n WHERE depth > 0 GROUP BY 1, 2) w
    ON w.depth = n.depth AND w.path = n.path
),
s AS (
  SELECT p.depth, p.path, sum((k.n_convs - 1) * k.size) AS saved_tokens, sum((k.n_children = 0)::BIGINT) AS n_leaves
  FROM k JOIN p ON p.conv_id = k.conv_id AND p.depth <= k.depth GROUP BY 1, 2
)
SELECT k.conv_id, k.depth, a.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, k.ends_sha256
FROM k JOIN s ON s.depth = k.depth AND s.path = k.path LEFT JOIN k a ON a.depth = k.depth - 1 AND a.path = k.above
"""


def registered() -> dict[str, str]:
    return {name: sql for name, sql in globals().items() if name.startswith("op")}
