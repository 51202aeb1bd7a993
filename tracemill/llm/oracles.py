"""SQL twins, for DuckDB, of the queries that SQL can express."""

#: Shingles as strings, all pairs that share one, links by whole sets, components by a recursive closure.
NEAR_DEDUP = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS nboth FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * nboth >= 80 * (na + nb - nboth)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.b) AS component_id, s.doc_id = min(r.b) AS kept FROM s JOIN r ON r.a = s.doc_id GROUP BY s.doc_id, s.s"""

#: Running sums over the documents in order; the checksum is built byte by byte from a table of 256 remainders.
SHARDING = r"""
WITH k AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS k FROM range(256) t(i)),
b AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) + 8 AS size FROM documents),
x AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(size - 8), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, v: xor(c >> 8, k[(xor(c, v) & 255) + 1])), 4294967295) AS text_crc32
  FROM (SELECT doc_id, size, hex(encode(t)) AS h, k FROM b, k)),
o AS (SELECT *, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS done, sum(size) OVER () AS total FROM x),
s AS (SELECT *, least(23, (2 * done - size) * 24 // (2 * total))::INT AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INT AS grown_shard FROM s"""

ORACLES = {"op5_near_dedup": NEAR_DEDUP, "op9_sharding": SHARDING}
