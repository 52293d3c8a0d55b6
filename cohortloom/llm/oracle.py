"""DuckDB SQL for the registered queries that SQL can express: secrets, WARC, decontamination, the n-gram join, repeats, lexical search.

Each follows its contract in the plainest way, by other means than the operator: all windows, all pairs that share a
shingle, all 400-byte strings. That is for tables of some thousand documents.
"""

from __future__ import annotations

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _either(word: str) -> str:
    """A word in either case of ASCII letters; the flag i would also take other scripts' letters."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key")

#: kind, pattern, what stands before the span, a condition on the span ``m``
_SECRETS = (
    ("assign", rf"""(?:{_KEYS})["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+""", "", rf"""regexp_matches(m, '^(?:{_KEYS})["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]{{6,}}$')"""),
    ("access", "AKIA[A-Z0-9]+", "", "length(m) >= 20"),
    ("hex", "[0-9a-f]+", "", "length(m) >= 24"),
    ("private_key", "-----BEGIN (?:[A-Z0-9]{1,12} ){0,3}PRIVATE KEY-----", "", "true"),
    ("host_token", "(?:^|[^A-Za-z0-9_])(?:gh[pousr]|glpat|xox[abprs])_[A-Za-z0-9]{30,}", "^[^A-Za-z0-9_]", "true"),
    ("jwt", r"(?:^|[^A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "^[^A-Za-z0-9_-]", "true"),
)


def _spans(rank: int, kind: str, pattern: str, before: str, holds: str) -> str:
    """Matches and the pieces between them add up to the text: starts are running sums of their lengths."""
    lead = f"CASE WHEN regexp_matches(m, '{before}') THEN 1 ELSE 0 END" if before else "0"
    return f"""
SELECT r, {rank} AS k, '{kind}' AS kind, e - length(m) + {lead} AS s, e FROM (
  SELECT r, m, sum(length(piece) + length(m)) OVER (PARTITION BY r ORDER BY j) AS e FROM (
    SELECT r, unnest(found) AS m, unnest(string_split_regex(text, '{pattern}')[1:len(found)]) AS piece, unnest(range(len(found))) AS j
    FROM (SELECT r, text, regexp_extract_all(text, '{pattern}') AS found FROM d) WHERE len(found) > 0))
WHERE {holds}"""


SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(_spans(k, *x) for k, x in enumerate(_SECRETS))}),
own AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k) FILTER (k < 3) AS base,
    string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k) AS spans
  FROM found GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN own USING (r)
"""

#: Base32 of 40 hex digits: five of them are 20 bits, which make four letters.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (
  SELECT page_id, octet_length(encode(payload)) AS n, sha1(payload) AS sha, max(page_id) OVER (PARTITION BY payload) AS top FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha, 5 * (k // 4) + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31) + 1, 1) FOR k IN range(32)], '') AS payload_digest,
  CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < top THEN top END AS refers_to
FROM d
"""

DECONTAMINATE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS ws FROM documents),
i AS (SELECT row_number() OVER () AS r, item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS ws FROM benchmark),
dw AS (SELECT r, p, list(w) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS g FROM (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM d)),
iw AS (SELECT r, p, list(w) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS g FROM (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM i)),
win AS (SELECT DISTINCT item, g, len(g) AS n FROM iw JOIN i USING (r) WHERE len(g) = 10 OR p = 0),
sizes AS (SELECT DISTINCT n FROM win),
places AS (SELECT r, p, n, g[1:n] AS g FROM dw JOIN sizes ON len(dw.g) >= n),
hits AS (SELECT r, p, places.n, item FROM places JOIN win ON places.g = win.g),
covered AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM hits)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""

NGRAM_JOIN = rf"""
WITH RECURSIVE d AS (SELECT doc_id, dense_rank() OVER (ORDER BY coalesce(text, '')) AS t, translate(coalesce(text, ''), {_AZ}) AS text FROM documents),
own AS (SELECT DISTINCT t, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
grams AS (SELECT t, p, list(w) OVER (PARTITION BY t ORDER BY p ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS g FROM (SELECT t, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM own)),
sets AS MATERIALIZED (SELECT DISTINCT t, hash(g) AS h, g FROM grams WHERE len(g) = 4 OR p = 0),
sizes AS (SELECT t, count(*) AS n FROM sets GROUP BY t),
pairs AS (
  SELECT x.t AS a, y.t AS b, count(*) AS c FROM sets x JOIN sets y ON x.h = y.h AND x.g = y.g AND x.t < y.t
  GROUP BY x.t, y.t),
links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN sizes p ON p.t = a JOIN sizes q ON q.t = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT t AS a, t AS b FROM sizes UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a),
least AS (SELECT t, min(doc_id) AS id FROM d GROUP BY t),
component AS (SELECT a AS t, min(id) AS component_id FROM reach JOIN least ON least.t = reach.b GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM d LEFT JOIN sizes USING (t) LEFT JOIN component USING (t)
"""

REPEATS = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS data, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') AS ws FROM documents),
grams AS (SELECT r, k, md5(data[k + 1 : k + 400]) AS g FROM d, unnest(range(octet_length(data) - 399)) AS x(k)),
twice AS (SELECT r, k FROM grams WHERE g IN (SELECT g FROM grams GROUP BY g HAVING count(*) > 1)),
edges AS (SELECT r, k, sum(CASE WHEN k <= before + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY k) AS run
  FROM (SELECT r, k, lag(k) OVER (PARTITION BY r ORDER BY k) AS before FROM twice)),
runs AS (SELECT r, run, min(k) AS s, max(k) + 400 AS e FROM edges GROUP BY r, run),
gone AS (SELECT r, sum(e - s) AS n_removed, count(*) AS n_spans FROM runs GROUP BY r),
ends AS (SELECT r, s, e FROM runs UNION ALL SELECT r, octet_length(data), octet_length(data) FROM d),
parts AS (SELECT r, s, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s, e), 0) AS begin_ FROM ends),
kept AS (SELECT r, sha256(unhex(string_agg(CASE WHEN s > begin_ THEN hex(data[begin_ + 1 : s]) ELSE '' END, '' ORDER BY begin_))) AS kept_sha256 FROM parts JOIN d USING (r) GROUP BY r),
lines AS (SELECT r, p, md5(string_agg(w, ' ') OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS g, n
  FROM (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS p, len(ws) AS n FROM d)),
whole AS (SELECT r, p, g FROM lines WHERE p + 50 <= n),
held AS (SELECT r, p FROM whole WHERE g IN (SELECT g FROM whole GROUP BY g HAVING count(DISTINCT r) > 1)),
gaps AS (SELECT r, least(50, coalesce(lead(p) OVER (PARTITION BY r ORDER BY p) - p, 50)) AS c FROM held),
words AS (SELECT r, sum(c) AS n_repeat_words FROM gaps GROUP BY r)
SELECT doc_id, octet_length(data)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  kept_sha256, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r) LEFT JOIN words USING (r)
"""

LEXICAL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS ws FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')) AS ws FROM benchmark),
g AS (SELECT count(*) FILTER (len(ws) > 0) AS big_n, sum(len(ws))::BIGINT AS l FROM d),
wanted AS (SELECT q, unnest(ws) AS w FROM i),
post AS (SELECT r, w, count(*) AS tf FROM (SELECT r, unnest(ws) AS w FROM d) WHERE w IN (SELECT w FROM wanted) GROUP BY r, w),
weights AS (SELECT w, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM (SELECT w, count(*) AS df FROM post GROUP BY w), g),
impacts AS (SELECT r, w, weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(ws)::BIGINT * big_n) // l))) AS part FROM post JOIN weights USING (w) JOIN d USING (r), g),
scores AS (SELECT q, r, sum(part)::BIGINT AS score FROM wanted JOIN impacts USING (w) GROUP BY q, r HAVING sum(part) > 0),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scores JOIN d USING (r) JOIN i USING (q))
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""

SQL = {"op1_secret_scan": SECRETS, "op2_warc_round_trip": WARC, "op4_decontaminate": DECONTAMINATE, "op9_ngram_join": NGRAM_JOIN, "op10_repeats": REPEATS, "op11_lexical_search": LEXICAL}
