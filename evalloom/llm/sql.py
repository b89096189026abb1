"""DuckDB SQL of the queries that SQL can express."""

#: A table of one row, the 256 remainders of CRC-32, and the checksum of a text's UTF-8 by them.
_CRC = "crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i) AS c FROM range(256) r(i)))"
_CRC_OF = "xor(list_reduce(list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda h: ('0x' || h)::BIGINT), lambda c, x: xor(c >> 8, crc.t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"
_HALF = "('0x' || sha256('17:{0}:' || r)[1:13])::BIGINT"
_ROUNDS = "".join(f",\nf{i + 1} AS (SELECT x, r AS l, (l + {_HALF.format(i)} % s) % s AS r, s FROM f{i})" for i in range(6))
#: op12: what insertions do from each state (0 nothing, 1 system, 2 user last, 3 assistant last), and what one edit does.
_MOVES = "m(st, ins, mid, said) AS (VALUES (0, '', 0, []::VARCHAR[]), (1, '', 1, []), (2, '', 2, []), (3, '', 3, []), (0, 'I', 2, ['user:']), (1, 'I', 2, ['user:']), (3, 'I', 2, ['user:']), (2, 'I', 3, ['assistant:']), (0, 'II', 3, ['user:', 'assistant:']), (1, 'II', 3, ['user:', 'assistant:']))"
_EDITS = "x(mid, edit, st, initial, put) AS (VALUES (0, 'D', 0, NULL, NULL), (1, 'D', 1, NULL, NULL), (2, 'D', 2, NULL, NULL), (3, 'D', 3, NULL, NULL), (0, 'K', 1, 's', NULL), (0, 'K', 2, 'u', NULL), (1, 'K', 2, 'u', NULL), (3, 'K', 2, 'u', NULL), (2, 'K', 3, 'a', NULL), (0, 'R', 2, NULL, 'user'), (1, 'R', 2, NULL, 'user'), (3, 'R', 2, NULL, 'user'), (2, 'R', 3, NULL, 'assistant'))"

ORACLE = {
    "op12_conversations": f"""
WITH RECURSIVE {_CRC}, {_MOVES}, {_EDITS},
d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC_OF.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
  FROM conversations, crc),
e AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM d, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
n AS (SELECT *, role[1:1] AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM e),
o AS (
  SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair, regexp_extract(text, '(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS seen
  FROM n),
f AS (SELECT *, final = '' AS blank, final <> '' AND seen AS duplicate, final NOT IN ('', '.', '!', '?') AND NOT seen AS cut FROM o),
s AS (
  SELECT conv_id, 0::BIGINT AS pos, 0 AS st, struct_pack(cost := 0, audit := '', said := []::VARCHAR[]) AS best FROM (SELECT DISTINCT conv_id FROM d)
  UNION ALL
  SELECT f.conv_id, f.pos, x.st, min(struct_pack(
    cost := (best).cost + 3 * length(ins) + CASE edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN cut AND edit <> 'D' THEN 3 ELSE 0 END,
    audit := (best).audit || ins || edit,
    said := (best).said || m.said || CASE edit WHEN 'D' THEN [] ELSE [coalesce(put, role) || ':' || text] END))
  FROM s JOIN m ON s.st = m.st JOIN f ON f.conv_id = s.conv_id AND f.pos = s.pos + 1 JOIN x ON x.mid = m.mid
  WHERE edit = 'D' OR NOT (blank OR duplicate) AND (edit = 'R' OR x.initial = f.initial)
  GROUP BY f.conv_id, f.pos, x.st),
g AS (
  SELECT conv_id, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (cut) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, max(pos) AS last
  FROM f GROUP BY conv_id),
z AS (
  SELECT s.conv_id, min(struct_pack(cost := (best).cost + 3 * length(ins), audit := (best).audit || ins, said := (best).said || m.said)) AS best
  FROM s LEFT JOIN g USING (conv_id) JOIN m USING (st) WHERE s.pos = coalesce(last, 0) AND mid IN (0, 3) GROUP BY s.conv_id)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  (best).cost::BIGINT AS cost, (best).audit AS audit, sha256(array_to_string((best).said, chr(10))) AS repaired_sha256
FROM z LEFT JOIN g USING (conv_id)
""",
    "op11_sharding": f"""
WITH RECURSIVE {_CRC},
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, {_CRC_OF.format("coalesce(text, '')")} AS text_crc32 FROM documents, crc),
n AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS x, count(*) OVER () AS rows FROM d),
f0 AS (SELECT x, x // s AS l, x % s AS r, s FROM (SELECT ceil(sqrt(count(*)))::BIGINT AS s FROM d), range(s * s) q(x)){_ROUNDS},
w AS (
  SELECT x, l * s + r AS y FROM f6
  UNION ALL SELECT w.x, f6.l * f6.s + f6.r FROM w JOIN f6 ON w.y = f6.x WHERE w.y >= (SELECT count(*) FROM d))
SELECT doc_id, size, text_crc32, 'rows' AS law, (y % 40)::INT AS shard, y // 40 AS slot, NULL::INT AS grown_shard FROM n JOIN w USING (x) WHERE y < rows
""",
    "op6_url_filter": r"""
WITH r(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
)
SELECT p.page_id, p.host, p.path,
  arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
  coalesce(arg_max(r.verdict, length(r.host || r.path)), 'allow') AS verdict
FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
GROUP BY p.page_id, p.host, p.path
""",
}
