"""DuckDB twin of the conversation trie, node by node."""

TRIE = r"""
WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT DISTINCT c, c - c % 100 AS base, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: ord(x)) AS bytes
  FROM own),
convs AS (
  SELECT c, base, xor(4294967295, list_reduce(bytes,
    lambda crc, x: list_reduce(range(8), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)), xor(crc, CAST(x AS BIGINT))),
    4294967295)) % 6 AS h
  FROM ids),
parts AS (
  SELECT v.c, t.pos AS k, role, text FROM convs v JOIN own t ON t.c = v.base AND t.pos <= v.h
  UNION ALL SELECT v.c, 1000000000 + t.pos, role, text FROM convs v JOIN own t ON t.c = v.c AND t.pos > v.h),
turns AS (
  SELECT c, row_number() OVER w AS p, CAST(length(text) AS BIGINT) AS n,
    string_agg(md5(role) || md5(text), '') OVER w AS path, count(*) OVER (PARTITION BY c) AS size
  FROM parts WINDOW w AS (PARTITION BY c ORDER BY k)),
steps AS (
  SELECT c, p, n, path, size FROM turns
  UNION ALL SELECT v.c, 0, 0, '', coalesce(z.size, 0) FROM convs v LEFT JOIN (SELECT DISTINCT c, size FROM turns) z ON z.c = v.c),
node AS (
  SELECT p, path, left(path, CAST(64 * (p - 1) AS BIGINT)) AS up, min(c) AS c, count(*) AS n, max(n) AS len,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (p = size), '')) AS ends
  FROM steps GROUP BY p, path),
kids AS (SELECT p - 1 AS p, up AS path, count(*) AS kids FROM node WHERE p > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(kids, 0) AS kids FROM node LEFT JOIN kids USING (p, path)),
below AS (
  SELECT s.p, s.path, sum(CASE WHEN f.kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((f.n - 1) * f.len) AS saved
  FROM full_node f JOIN steps s ON s.c = f.c AND s.p <= f.p GROUP BY s.p, s.path)
SELECT f.c AS conv_id, CAST(f.p AS BIGINT) AS depth, u.c AS parent_conv_id, CAST(f.n AS BIGINT) AS n_convs,
  CAST(f.kids AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
  f.ends AS ends_sha256
FROM full_node f JOIN below b ON b.p = f.p AND b.path = f.path
LEFT JOIN full_node u ON f.p > 0 AND u.p = f.p - 1 AND u.path = f.up
"""
