"""DuckDB SQL of the queries that SQL can state on whole tables."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op1_url_rules"] = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw, coalesce(rest, '') AS rest FROM cut),
judged AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM parts),
rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (
  SELECT j.page_id, j.host, j.path, arg_max(struct_pack(r := r.host || r.path, v := r.verdict), length(r.host || r.path)) AS b
  FROM judged j LEFT JOIN rules r
    ON (j.host = r.host OR ends_with(j.host, '.' || r.host)) AND starts_with(j.path, r.path)
  GROUP BY ALL)
SELECT page_id, host, path, b.r AS rule, coalesce(b.v, 'allow') AS verdict FROM best
"""

#: Copies of each document: per source the Poisson distribution function, compared with the document's hashed number.
MIX = r"""
sizes AS (SELECT source, count(*) AS n, round(sqrt(count(*)) * 1000) AS w FROM {docs} GROUP BY source),
rated AS (SELECT source, (SELECT sum(n) FROM sizes)::DOUBLE * w / ((SELECT sum(w) FROM sizes) * n) AS rate FROM sizes),
parted AS (SELECT source, greatest(1, ceil(rate / 32.0))::INT AS parts, rate / greatest(1, ceil(rate / 32.0))::INT AS lam FROM rated),
terms AS (
  WITH RECURSIVE t AS (
    SELECT source, lam, 0 AS k, exp(-lam) AS p, exp(-lam) AS c FROM parted
    UNION ALL SELECT source, lam, k + 1, p * lam / (k + 1), c + p * lam / (k + 1) FROM t
    WHERE k < ceil(lam + 12 * sqrt(lam) + 20))
  SELECT source, list(c ORDER BY k) AS steps FROM t GROUP BY source),
drawn AS (
  SELECT d.*, list_sum(list_transform(range(1, parts + 1), lambda j: len(list_filter(steps, lambda c:
      c <= ('0x' || md5('7|' || coalesce(doc_id::VARCHAR, 'null') || '|' || j::VARCHAR)[1:13])::BIGINT / 4503599627370496.0)))) AS copies
  FROM {docs} d JOIN parted p ON d.source IS NOT DISTINCT FROM p.source JOIN terms t ON d.source IS NOT DISTINCT FROM t.source),
mixed AS (SELECT doc_id, text, lang, source, n_chars, copies::INT AS copies, unnest(range(0, copies::INT))::INT AS copy FROM drawn)
"""
ORACLE["op3_mixing"] = "WITH " + MIX.format(docs="documents") + "SELECT * FROM mixed"

#: CRC-32 of a text's UTF-8 bytes, by the table of the reversed polynomial.
CRC = r"""
steps AS (SELECT i::BIGINT AS i, 0 AS k, i::BIGINT AS v FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS bytes FROM steps WHERE k = 8)
"""

ORACLE["op4_sharding"] = "WITH RECURSIVE " + CRC + r""",
sized AS (SELECT doc_id, (strlen(coalesce(text, '')) + 1)::BIGINT AS size,
  list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS text FROM documents),
summed AS (SELECT *, sum(size) OVER (ORDER BY doc_id) - size AS before, sum(size) OVER () AS whole FROM sized),
cut AS (SELECT *, least(7, floor((before + size / 2) * 8 / whole))::INT AS shard FROM summed)
SELECT doc_id, size,
       xor(list_reduce(list_prepend(4294967295, text), lambda a, b: xor(a >> 8, bytes[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32,
       'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INT AS grown_shard
FROM cut, crc
"""

ORACLE["op5_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, payload_bytes,
  upper(translate(list_aggregate(list_transform(range(0, 8),
    lambda i: to_base(('0x' || hex[1 + 5 * i:5 + 5 * i])::BIGINT, 32, 4)), 'string_agg', ''),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')) AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM h
"""

ORACLE["op10_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""

ORACLE["op13_hard_negatives"] = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS whole
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, v.vec_id AS other_id, a.label = v.label AS same, list_inner_product(a.whole, v.whole)::BIGINT AS score
  FROM v AS a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
good AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM good JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY rank <= 5
"""
