"""DuckDB SQL of the conversation repair: the cheapest edits to each state, row by row."""


def _more(weight: str, cost: str, edit: str) -> str:
    """A weight (cost in nine digits, then the audit) after an edit."""
    return f"(lpad(CAST(CAST(({weight})[1:9] AS BIGINT) + {cost} AS VARCHAR), 9, '0') || ({weight})[10:] || '{edit}')"


_OPEN = "least(w0, w1, w3)"
_USER = f"least(k2, {_more('k0', '5', 'I')}, {_more('k1', '5', 'I')}, {_more('k3', '5', 'I')})"
_PAIR = f"least(k3, {_more('least(k2, ' + _more('k0', '5', 'I') + ', ' + _more('k1', '5', 'I') + ')', '5', 'I')})"

REPAIR_SQL = rf"""
WITH RECURSIVE bits(i, crc, k) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END, k + 1 FROM bits WHERE k < 8),
crcs AS (SELECT list(crc ORDER BY i) AS t FROM bits WHERE k = 8),
fated AS (
  SELECT c.*, xor(list_reduce(list_transform(string_split(COALESCE(CAST(conv_id AS VARCHAR), ' ') || ':'
           || COALESCE(CAST(turn AS VARCHAR), ' '), ''), lambda ch: ascii(ch)::BIGINT),
           lambda crc, b: xor(crc >> 8, t[(xor(crc, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS fate
  FROM conversations c, crcs),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE COALESCE(role, ' ') END AS role,
         CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(COALESCE(text, ' '), '[.!?]', '', 'g')
              ELSE COALESCE(text, ' ') END AS text, copy
  FROM fated, range(2) r(copy) WHERE fate <> 0 AND (copy = 0 OR fate = 3)),
placed AS (
  SELECT *, row_number() OVER w AS pos, lag(role[1:1]) OVER w || role[1:1] AS pair,
         regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
judged AS (
  SELECT *, CASE WHEN body = '' THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(body, '[.!?]$') THEN 'truncated' END AS fault,
         COALESCE(pair NOT IN ('su', 'ua', 'au'), false) AS bad
  FROM placed),
marked AS (
  SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x'
                 WHEN fault = 'truncated' THEN upper(m) ELSE m END AS mark
  FROM (SELECT *, CASE WHEN role[1:1] IN ('s', 'u', 'a') THEN role[1:1] ELSE 'o' END AS m FROM judged)),
shapes AS (
  SELECT conv_id, COALESCE(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (bad) AS illegal,
         list(mark ORDER BY pos) AS marks, list(role ORDER BY pos) AS roles, list(text ORDER BY pos) AS texts
  FROM marked GROUP BY conv_id),
-- The cheapest edits to each of the four states as text: cost in nine digits, then the audit.
steps(conv_id, i, w0, w1, w2, w3) AS (
  SELECT conv_id, 0, '000000000', CAST(NULL AS VARCHAR), '000000005I', '000000010II' FROM shapes
  UNION ALL
  SELECT conv_id, i, k0, k1, {_USER}, {_PAIR}
  FROM (
    SELECT conv_id, i + 1 AS i, {_more('w0', '2', 'D')} AS k0,
           least({_more('w1', '2', 'D')}, CASE WHEN lower(m) = 's' THEN {_more('w0', 'late', 'K')} END) AS k1,
           least({_more('w2', '2', 'D')},
                 CASE WHEN lower(m) = 'u' THEN {_more(_OPEN, 'late', 'K')} END,
                 CASE WHEN m <> 'x' THEN {_more(_OPEN, '1 + late', 'R')} END) AS k2,
           least({_more('w3', '2', 'D')}, CASE WHEN lower(m) = 'a' THEN {_more('w2', 'late', 'K')} END,
                 CASE WHEN m <> 'x' THEN {_more('w2', '1 + late', 'R')} END) AS k3
    FROM (SELECT t.*, s.marks[t.i + 1] AS m, CASE WHEN s.marks[t.i + 1] IN ('S', 'U', 'A', 'O') THEN 5 ELSE 0 END AS late
          FROM steps t JOIN shapes s ON s.conv_id IS NOT DISTINCT FROM t.conv_id AND t.i < len(s.marks)))),
found AS (
  SELECT s.*, least(t.w0, t.w3)[10:] AS audit, CAST(least(t.w0, t.w3)[1:9] AS BIGINT) AS cost
  FROM shapes s JOIN steps t ON s.conv_id IS NOT DISTINCT FROM t.conv_id AND t.i = len(s.marks)),
edits AS (
  SELECT *, string_split(audit, '')[k] AS edit,
         len(replace(audit[:k], 'I', '')) AS row_no
  FROM found, LATERAL (SELECT unnest(range(1, len(audit) + 1)) AS k)),
said AS (
  SELECT conv_id, k, edit, roles[row_no] AS role, texts[row_no] AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY k) AS place,
         max(CASE WHEN edit = 'K' AND roles[row_no][1:1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS opened
  FROM edits WHERE edit <> 'D'),
whole AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - opened) % 2 = 1 THEN 'user' ELSE 'assistant' END
                  || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS body
  FROM said GROUP BY conv_id)
SELECT o.conv_id, COALESCE(gaps, 0) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate,
       COALESCE(truncated, 0) AS truncated, COALESCE(illegal, 0) AS illegal, COALESCE(cost, 0) AS cost,
       COALESCE(audit, '') AS audit, sha256(COALESCE(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN found f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN whole w ON w.conv_id IS NOT DISTINCT FROM o.conv_id
"""
