"""DuckDB SQL with the results of the queries that SQL can express."""

from .pii import IBAN

_WORD = r"[^\x20\x09-\x0D]"

QUALITY_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{_WORD}+') AS ws,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS ls FROM t),
f AS (SELECT doc_id, text, ls, len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS stutters, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        CASE WHEN len(ws) < 8 THEN [] ELSE list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' ')) END AS wins FROM w),
e AS (SELECT doc_id, unnest(wins) AS win, generate_subscripts(wins, 1) AS i FROM f),
d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM e),
s AS (SELECT doc_id, least(coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8), 8) AS covers FROM d WHERE c > 1),
r AS (SELECT doc_id, sum(covers)::BIGINT AS n FROM s GROUP BY doc_id),
g AS (SELECT f.*, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
        (n_words < 20 OR 100 * coalesce(r.n, 0) > 30 * n_words) AS base_failed FROM f LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 25 * n_words
    OR word_chars > 20 * n_words OR word_chars < 2 * n_words
    OR (len(ls) >= 4 AND 100 * n_dup_lines > 50 * len(ls))
    OR 100 * stutters > 30 * n_words
    OR 100 * len(regexp_extract_all(text, '[A-Z]')) > 50 * word_chars
    OR 100 * len(regexp_extract_all(text, '[!?]')) > 30 * n_words
    OR 100 * len(regexp_extract_all(text, '\p{{L}}')) < 50 * word_chars) AS kept
FROM g
"""

CHAT_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(text, '([\[<])(\\*)(/?INST\]|/?ROLE\]|NEXT\]|/?s>|</?SYS>>)', '\1\\\2\3', 'g') AS esc,
  coalesce(lag(role) OVER o <> role, true) AS starts, coalesce(lead(role) OVER o <> role, true) AS ends
  FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
p AS (SELECT *, CASE WHEN NOT starts THEN 6 WHEN role = 'user' THEN 6 WHEN role = 'assistant' THEN 3 WHEN role = 'system' THEN 7 ELSE 12 + length(role) END
  + length(esc) + CASE WHEN NOT ends THEN 0 WHEN role = 'user' THEN 7 WHEN role = 'assistant' THEN 4 WHEN role = 'system' THEN 8 ELSE 7 END AS chars FROM e)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""


def _placed(kind: str, pattern: str, source: str) -> str:
    """A table of the matches of a pattern: doc_id, a (start), b (end), m (match)."""
    quoted = pattern.replace("'", "''")
    return rf"""
{kind}_l AS (SELECT doc_id, text, regexp_extract_all(text, '{quoted}') AS ms, regexp_split_to_array(text, '{quoted}') AS gs FROM {source}),
{kind}_u AS (SELECT doc_id, text, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, generate_subscripts(ms, 1) AS i FROM {kind}_l WHERE len(ms) > 0),
{kind}_p AS (SELECT doc_id, text, m, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM {kind}_u),
{kind}_m AS (SELECT doc_id, text, m, (b - length(m))::BIGINT AS a, b::BIGINT AS b FROM {kind}_p)"""


_PART = "0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_BEFORE = "substring(text, greatest(a - 40, 0) + 1, a - greatest(a - 40, 0))"
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i:
  CASE WHEN (length({_DIGITS}) - i) % 2 = 1 THEN (2 * {_DIGITS}[i]::INT) // 10 + (2 * {_DIGITS}[i]::INT) % 10 ELSE {_DIGITS}[i]::INT END)) % 10 = 0"""
_TURNED = "(regexp_replace(m, ' ', '', 'g')[5:] || regexp_replace(m, ' ', '', 'g')[1:4])"
_MOD97 = f"""list_reduce(list_prepend(0::BIGINT, list_transform(string_split({_TURNED}, ''), lambda c:
  CASE WHEN c >= 'A' THEN (ascii(c) - 55)::BIGINT ELSE c::BIGINT END)), lambda x, y: CASE WHEN y > 9 THEN (x * 100 + y) % 97 ELSE (x * 10 + y) % 97 END) = 1"""

PII_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{_placed("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "t")},
{_placed("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "t")},
{_placed("card", r"[0-9](?:[\x20-]?[0-9])+", "t")},
{_placed("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "t")},
{_placed("iban", rf"\b(?:{IBAN})\b", "t")},
{_placed("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "t")},
s AS (
  SELECT doc_id, 0 AS k, 'email' AS kind, a, b FROM email_m
  UNION ALL SELECT doc_id, 1, 'ip', a, b FROM ip_m WHERE regexp_full_match(m, '{_PART}([.]{_PART}){{3}}')
  UNION ALL SELECT doc_id, 2, 'card', a, b FROM card_m WHERE length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}
  UNION ALL SELECT doc_id, 3, 'phone', a, b FROM phone_m WHERE length({_DIGITS}) BETWEEN 9 AND 15
  UNION ALL SELECT doc_id, 4, 'iban', a, b FROM iban_m WHERE {_MOD97}
  UNION ALL SELECT doc_id, 5, 'ssn', a, b FROM ssn_m WHERE regexp_matches({_BEFORE}, '(?i)ssn|social|security')),
j AS (SELECT doc_id,
  count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (k < 4) AS base,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans FROM s GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card,
  coalesce(n_phone, 0)::BIGINT AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN j ON t.doc_id = j.doc_id
"""

SECRETS_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{_placed("assign", r'''(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(?:[A-Za-z0-9+/_.=-]+)''', "t")},
{_placed("access", r"AKIA[A-Z0-9]+", "t")},
{_placed("hex", r"[0-9a-f]+", "t")},
{_placed("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[^-]*(?:-----END (?:[A-Z]+ )?PRIVATE KEY-----)?", "t")},
{_placed("github", r"gh[pousr]_[A-Za-z0-9]{36,}", "t")},
{_placed("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "t")},
s AS (
  SELECT doc_id, 0 AS k, 'assign' AS kind, a, b FROM assign_m
    WHERE length(regexp_extract(m, '(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)) >= 6
  UNION ALL SELECT doc_id, 1, 'access', a, b FROM access_m WHERE length(m) >= 20
  UNION ALL SELECT doc_id, 2, 'hex', a, b FROM hex_m WHERE length(m) >= 24
  UNION ALL SELECT doc_id, 3, 'private_key', a, b FROM private_key_m
  UNION ALL SELECT doc_id, 4, 'github', a, b FROM github_m
  UNION ALL SELECT doc_id, 5, 'jwt', a, b FROM jwt_m),
j AS (SELECT doc_id,
  count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (k < 3) AS base,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans FROM s GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN j ON t.doc_id = j.doc_id
"""


def _nearest(number: int) -> str:
    """Each vector's cluster and squared distance by the centroids of round ``number``."""
    return f"""
d{number} AS MATERIALIZED (SELECT row, c, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept CROSS JOIN c{number}),
a{number} AS MATERIALIZED (SELECT row, min(struct_pack(d := d, c := c)) AS best FROM d{number} GROUP BY row)"""


def _moved(number: int) -> str:
    """The centroids of round ``number``, from the round before."""
    return f"""
s{number} AS (SELECT best.c AS c, i, sum(v[i]) AS s, count(*) AS n FROM a{number - 1} JOIN kept USING (row), range(1, 65) AS r(i) GROUP BY best.c, i),
n{number} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS m FROM s{number} GROUP BY c),
c{number} AS MATERIALIZED (SELECT c, coalesce(n.m, o.m) AS m FROM c{number - 1} AS o LEFT JOIN n{number} AS n USING (c))"""


CLUSTERS_SQL = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = 64),
f AS (SELECT v, sha256('1:' || vec_id) AS h FROM kept ORDER BY h LIMIT 16),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS m FROM f),
{_nearest(0)}, {_moved(1)}, {_nearest(1)}, {_moved(2)}, {_nearest(2)}, {_moved(3)}, {_nearest(3)}
SELECT vec_id, best.c::INT AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a3 JOIN kept USING (row) JOIN c3 ON c3.c = best.c
"""

_CUTS = ", ".join(f"CASE WHEN len(ws) > {k} THEN {{'part': {k}, 'first': array_to_string(ws[1:{k}], ' '), 'rest': array_to_string(ws[{k + 1}:], ' ')}} END" for k in range(1, 5))

COLLOCATIONS_SQL = rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?
-
]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) AS r(k) WHERE len(ws) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT * FROM f WHERE k > 1 AND a >= 100),
inner_ AS (SELECT lang, k AS longer, a AS b, array_to_string(string_split(phrase, ' ')[i:j], ' ') AS phrase FROM c, range(1, 5) AS x(i), range(2, 6) AS y(j) WHERE j > i AND j <= k AND j - i + 1 < k),
hidden AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN inner_ AS o ON c.lang = o.lang AND c.phrase = o.phrase AND c.k < o.longer AND 100 * o.b >= 100 * c.a),
left_ AS (SELECT c.lang, c.phrase, c.a, string_split(c.phrase, ' ') AS ws FROM c ANTI JOIN hidden AS h ON c.lang = h.lang AND c.phrase = h.phrase),
cut AS (SELECT lang, phrase, a, unnest([x FOR x IN [{_CUTS}] IF x IS NOT NULL]) AS x FROM left_),
s AS (SELECT cut.lang, cut.phrase, cut.a, x.part AS part, l.a AS l, r.a AS r, n.n AS n, (1000::HUGEINT * cut.a * n.n) // (l.a::HUGEINT * r.a) AS score
  FROM cut JOIN f AS l ON l.lang = cut.lang AND l.phrase = x.first JOIN f AS r ON r.lang = cut.lang AND r.phrase = x.rest JOIN n ON n.lang = cut.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, part) AS place FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM b WHERE place = 1)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM o WHERE rank <= 2000
"""
