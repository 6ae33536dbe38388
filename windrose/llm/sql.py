"""SQL of the corpus queries whose results it can express exactly, by other ways than the operators'."""

#: N-grams as joined words instead of rolling hashes.
OP6_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, length(unnest(w)) AS c FROM w),
b AS (SELECT doc_id, len(w) AS n, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
v AS (SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) AS line_chars, coalesce(list_sum(list_transform(list_distinct(lines), lambda x: length(x))), 0) AS own_chars FROM b),
g AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS x FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, range(2, 11) r(m))),
k AS (SELECT doc_id, m, x, count(*) AS times, min(i) AS first FROM g GROUP BY ALL HAVING count(*) > 1),
top AS (SELECT doc_id, m, arg_max(x, (times, -first)) AS x FROM k WHERE m < 5 GROUP BY 1, 2),
cover AS (SELECT doc_id, CASE WHEN m = 3 THEN 103 ELSE m END AS m, i + o AS i FROM g SEMI JOIN k USING (doc_id, m, x), range(0, 10) q(o) WHERE o < m AND (m = 3 OR m > 4)
  UNION SELECT doc_id, m, i + o FROM g SEMI JOIN top USING (doc_id, m, x), range(0, 10) q(o) WHERE o < m),
share AS (SELECT doc_id, m, count(*) AS words, sum(c) AS chars FROM cover JOIN t USING (doc_id, i) GROUP BY 1, 2),
s AS (SELECT doc_id, list(coalesce(chars, 0) / greatest(word_chars, 1) ORDER BY r.m) FILTER (r.m < 5) AS top_gram_shares, list(coalesce(chars, 0) / greatest(word_chars, 1) ORDER BY r.m) FILTER (r.m > 4) AS dup_gram_shares
  FROM v CROSS JOIN range(2, 11) r(m) LEFT JOIN share USING (doc_id, m) WHERE n > 0 GROUP BY 1),
f AS (SELECT doc_id, n AS n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, coalesce(words, 0) AS n_repeat_words, n < 50 OR 100 * coalesce(words, 0) > 50 * n AS base_failed,
  n_dup_lines / greatest(len(lines), 1) AS dup_line_share, (line_chars - own_chars) / greatest(line_chars, 1) AS dup_line_char_share, coalesce(top_gram_shares, []) AS top_gram_shares, coalesce(dup_gram_shares, []) AS dup_gram_shares
  FROM v LEFT JOIN (SELECT doc_id, words FROM share WHERE m = 103) USING (doc_id) LEFT JOIN s USING (doc_id))
SELECT *, NOT (base_failed OR dup_line_share > 0.3 OR dup_line_char_share > 0.2 OR coalesce(top_gram_shares[1] > 0.2 OR top_gram_shares[2] > 0.18 OR top_gram_shares[3] > 0.16, false)
  OR coalesce(dup_gram_shares[1] > 0.15 OR dup_gram_shares[2] > 0.14 OR dup_gram_shares[3] > 0.13 OR dup_gram_shares[4] > 0.12 OR dup_gram_shares[5] > 0.11 OR dup_gram_shares[6] > 0.1, false)) AS kept FROM f
"""

#: All pairs that share a shingle, and the closure of the links.
OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) > 0),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c),
c AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(len(s), 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w LEFT JOIN s USING (doc_id) JOIN c USING (doc_id)
"""

#: Every string of 200 bytes by its digest.
OP10_SQL = r"""
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT doc_id, i, md5(b[i:i + 199]) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 198)) AS i FROM b)),
k AS (SELECT h FROM s GROUP BY 1 HAVING count(*) > 1),
r AS (SELECT doc_id, i, i - lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) > 200 AS fresh FROM s SEMI JOIN k USING (h)),
g AS (SELECT doc_id, i, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
p AS (SELECT doc_id, min(i) AS lo, max(i) + 199 AS hi FROM g GROUP BY doc_id, run),
q AS (SELECT doc_id, list(lo ORDER BY lo) AS lo, list(hi ORDER BY lo) AS hi, sum(hi - lo + 1) AS n_removed, count(*) AS n_spans FROM p GROUP BY 1),
x AS (SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN n_spans IS NULL THEN b ELSE list_reduce(list_transform(range(0, len(lo) + 1), lambda j: b[coalesce(hi[j], 0) + 1:coalesce(lo[j + 1] - 1, octet_length(b))]), lambda m, n: m || n) END AS kept FROM b LEFT JOIN q USING (doc_id))
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans, sha256(kept) AS kept_sha256 FROM x
"""
