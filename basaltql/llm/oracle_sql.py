"""DuckDB SQL for the operators that SQL can express; ``queries.ORACLE`` maps query names to these texts."""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT row_number() OVER () AS i, item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT i, item_id, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT i, item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM items WHERE len(w) > 0)
), grams AS (
  SELECT r, p, n, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), found AS (SELECT r, p, grams.n, i, item_id FROM grams JOIN windows USING (n, g)),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM found) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, i, item_id::VARCHAR AS id FROM found) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""



def _crc_nibbles() -> list[int]:
    """CRC-32 of each half byte (reflected polynomial 0xEDB88320)."""
    table = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    return table


_CRC_NIBBLES = _crc_nibbles()

OP4 = f"""
WITH RECURSIVE body AS (
  SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents
), sized AS (
  SELECT doc_id, length(h) // 2 + 1 AS size,
         xor(list_reduce(list_transform(list_filter(string_split(regexp_replace(h, '(.)(.)', '\\2\\1', 'g'), ''), lambda d: d <> ''), lambda d: ('0x' || d)::BIGINT),
             lambda acc, d: xor(acc >> 4, {_CRC_NIBBLES}[(xor(acc, d) & 15) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32
  FROM body
), jump(doc_id, k, b, j, n) AS (
  SELECT d.doc_id, CASE WHEN d.doc_id < 0 THEN d.doc_id::HUGEINT + 18446744073709551616::HUGEINT
                        ELSE coalesce(d.doc_id, 0)::HUGEINT END, 0::BIGINT, 0::BIGINT, s.n
  FROM (SELECT DISTINCT doc_id FROM documents) d, (VALUES (16), (17)) s(n)
  UNION ALL
  SELECT doc_id, k2, j, floor((j + 1)::DOUBLE * (2147483648::DOUBLE / ((k2 // 8589934592)::DOUBLE + 1)))::BIGINT, n
  FROM (SELECT *, (k * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k2 FROM jump WHERE j < n)
), placed AS (
  SELECT doc_id, max(b) FILTER (WHERE n = 16 AND j >= n) AS shard, max(b) FILTER (WHERE n = 17 AND j >= n) AS grown_shard
  FROM jump GROUP BY doc_id
)
SELECT s.doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
       (row_number() OVER (PARTITION BY shard ORDER BY s.doc_id, text_crc32, size) - 1)::BIGINT AS slot,
       grown_shard::INTEGER AS grown_shard
FROM sized s JOIN placed p ON s.doc_id IS NOT DISTINCT FROM p.doc_id
"""

# Base32 of the SHA-1 digest: five hex digits are four letters.
OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, h, max(page_id) OVER (PARTITION BY h) AS response FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substring(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN response IS NULL OR page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM response THEN response END AS refers_to
FROM r
"""
