"""DuckDB statements that must give the rows of the queries of the same number."""

from __future__ import annotations

OP1 = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), bits AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS hash,
    bit::VARCHAR AS b FROM (SELECT *, unhex(sha1(payload))::BIT AS bit FROM p)
), named AS (
  SELECT page_id, payload_bytes, max(page_id) OVER (PARTITION BY hash) AS response,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum([
      (substr(b, 5 * k + j + 1, 1) = '1')::INT * (16 >> j) for j in range(0, 5)])::INT, 1) for k in range(0, 32)], '') AS payload_digest
  FROM bits
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = response THEN NULL ELSE response END AS refers_to
FROM named
"""

OP2 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)
), twice AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM twice, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d
), judged AS (
  SELECT doc_id, l, regexp_matches(l, '[^\x20\x09-\x0D]') AS worded,
    regexp_matches(l, '[^\x20\x09-\x0D]') AND (
      NOT regexp_matches(l, '[.!?…:;,"''”’»)\]。！？][\x20\x09-\x0D]*$|\p{Ll}[.!?]+[\x20\x09]')
      OR length(l) - length(translate(l, '|»›>', '')) >= 3
      OR regexp_matches(l, '(?i)(all rights reserved|licensed under|released under the|terms of (use|service)|privacy policy|cookie policy|accept cookies|enable javascript|lorem ipsum|sign in to|log in to|subscribe to our|click here|read more|powered by|skip to (main )?content|share this (page|article)|page not found)')
      OR len(regexp_extract_all(l, '[#*$%&]{2,}')) >= 3
      OR (NOT regexp_matches(l, '\p{Ll}') AND regexp_matches(l, '\p{Lu}{2}'))) AS fails
  FROM lines
), per_doc AS (
  SELECT doc_id, count(*) FILTER (WHERE worded) - count(DISTINCT l) FILTER (WHERE worded) AS n_dup_lines,
    count(*) FILTER (WHERE fails) AS n_removed_lines,
    coalesce(sum(length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g'))) FILTER (WHERE NOT fails), 0)::BIGINT AS kept_chars
  FROM judged GROUP BY doc_id
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, n_removed_lines, kept_chars
  FROM d JOIN per_doc USING (doc_id) LEFT JOIN covered USING (doc_id)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
    AND 100 * (word_chars - kept_chars) <= 30 * word_chars AS kept
FROM m
"""

OP3 = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations
), said AS (
  SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
    string_agg(md5(concat_ws('|', role IS NULL, coalesce(role, ''), text IS NULL, coalesce(text, ''))), '')
      OVER (w ROWS UNBOUNDED PRECEDING) AS prefix
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), last AS (
  SELECT prefix, min(conv_id) AS conv_id, count(*) AS copies FROM said WHERE pos = n GROUP BY prefix
), kept AS (
  SELECT conv_id, copies FROM last
  WHERE NOT EXISTS (SELECT 1 FROM said WHERE said.pos < said.n AND said.prefix = last.prefix)
)
SELECT conv_id, turn // 1024 AS part, count(*) AS n_turns, any_value(copies) AS copies,
  string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || replace(coalesce(text, ''), '<|', '< |')
    || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
FROM said JOIN kept USING (conv_id) GROUP BY conv_id, turn // 1024
"""

OP11 = r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, i, ls[i] AS line, translate(regexp_replace(regexp_replace(ls[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)
), often AS (
  SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT doc_id, i, line, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM l LEFT JOIN often USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP12 = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, lang, source, unnest(regexp_extract_all(
    translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), vocabulary AS (
  SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 3
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM w JOIN vocabulary USING (lang, term) GROUP BY lang, source, term
), sizes AS (SELECT lang, count(*) AS v FROM vocabulary GROUP BY lang
), groups AS (
  SELECT lang, source, coalesce(own, 0)::HUGEINT AS own, coalesce(v, 0)::HUGEINT AS v FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(n) AS own FROM counts GROUP BY lang, source) USING (lang, source) LEFT JOIN sizes USING (lang)
), shares AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (own + v) AS p
  FROM groups JOIN vocabulary USING (lang) LEFT JOIN counts USING (lang, source, term)
), lang_shares AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (total + v) AS q
  FROM (SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total FROM counts GROUP BY lang, term) JOIN sizes USING (lang)
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT x.lang, x.source, y.source AS other, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS f
    FROM shares x JOIN shares y USING (lang, term) GROUP BY x.lang, x.source, y.source) s
  ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
), best AS (
  SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value
  FROM shares JOIN lang_shares USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (
    SELECT * FROM pairs UNION ALL SELECT * FROM best))
WHERE part = 'pair' OR rank <= 200
"""

OP13 = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), m AS (
  SELECT doc_id, part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
    + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS mask FROM d
), known AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), cells AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN known USING (doc_id)
  GROUP BY part, mask
), letters AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(l, b)
), orders AS (
  SELECT v.l || w.l || x.l || y.l || z.l AS filter_order, [v.b, w.b, x.b, y.b, z.b] AS bits
  FROM letters v, letters w, letters x, letters y, letters z WHERE v.b + w.b + x.b + y.b + z.b = 31 AND v.b | w.b | x.b | y.b | z.b = 31
), steps AS (
  SELECT filter_order, s AS step, bits[s] AS own, coalesce(list_sum(bits[1:s - 1]), 0)::INT AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS s)
)
SELECT part, filter_order, step::INT AS step,
  sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
  sum(CASE WHEN mask & own <> 0 THEN n * (120 // bit_count(mask)) ELSE 0 END)::BIGINT AS shapley
FROM cells, steps GROUP BY part, filter_order, step
"""
