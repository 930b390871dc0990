"""DuckDB SQL for the scans: personal data, secrets, and benchmark passages.

Written from the definitions, with other means than the operators: matches are placed by
window sums over rows, entropy is taken of each window from its characters' counts, seeds
are the selected words themselves.
"""

from __future__ import annotations

import math

from . import decontam, pii, secret_scan

_WS = r"[^\x20\x09-\x0D]+"
_ROWS = "d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" for c in word)


def _matches(table: str, kind: int, pattern: str, keep: str, text: str = "text", key: str = "r") -> str:
    """key, k, s, e and m of the matches ``m`` of ``pattern`` for which ``keep`` holds."""
    p = _quoted(pattern)
    cut = f"SELECT {key}, unnest(regexp_extract_all({text}, {p})) AS m, unnest(regexp_split_to_array({text}, {p})) AS g, unnest(range(1, 2 + len(regexp_extract_all({text}, {p})))) AS i FROM {table}"
    placed = f"SELECT {key}, m, (sum(length(g) + length(m)) OVER (PARTITION BY {key} ORDER BY i) - length(m))::BIGINT AS s FROM ({cut}) WHERE m IS NOT NULL"
    return f"SELECT {key}, {kind} AS k, s, s + length(m) AS e, m FROM ({placed}) WHERE {keep}"


def _digest(kinds: tuple[str, ...], order: str) -> str:
    names = "[" + ", ".join(map(_quoted, kinds)) + "]"
    return f"string_agg({names}[k + 1] || ':' || s || ':' || e, ',' ORDER BY {order})"


def op5() -> str:
    names = "|".join((*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")))
    assign = rf"""(?:{names})["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
    value = rf"""^(?:{names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    window = secret_scan.WINDOW
    allowed = " OR ".join(f"regexp_full_match(m, {_quoted(p.replace('++', '+').replace('*+', '*'))})" for p in secret_scan.ALLOW)
    bits = " ".join(f"WHEN regexp_full_match(m, {_quoted(c)}) THEN {b}" for _, c, b in secret_scan.CLASSES)
    return f"""
WITH {_ROWS},
base AS ({_matches("d", 0, assign, f"length(regexp_extract(m, {_quoted(value)}, 1)) >= 6")}
  UNION ALL {_matches("d", 1, "AKIA[A-Z0-9]+", "length(m) >= 20")} UNION ALL {_matches("d", 2, "[0-9a-f]+", "length(m) >= 24")}),
cand AS (SELECT row_number() OVER () AS c, r, s, m, CASE {bits} END AS bits FROM ({_matches("d", 3, "[A-Za-z0-9+/_=-]+", f"length(m) >= {window}")})
  WHERE regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND NOT ({allowed})),
win AS (SELECT c, r, s + i AS pos, bits, substr(m, i + 1, {window}) AS w FROM (SELECT *, unnest(range(0, length(m) - {window - 1})) AS i FROM cand)),
high AS (SELECT c, r, pos FROM win WHERE {math.log2(window)!r} - list_sum(list_transform(map_values(list_histogram(string_split(w, ''))), lambda n: n * log2(n))) / {window} >= bits - 1e-9),
part AS (SELECT c, r, pos, sum(fresh) OVER (PARTITION BY c ORDER BY pos) AS p FROM (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY c ORDER BY pos) <= {window} THEN 0 ELSE 1 END AS fresh FROM high)),
every AS (SELECT r, k, s, e FROM base UNION ALL SELECT r, 3, min(pos), max(pos) + {window} FROM part GROUP BY c, r, p),
agg AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, count(*) FILTER (k = 3) AS n_entropy,
  {_digest(secret_scan.KINDS, "s, k")} FILTER (k < 3) AS base, {_digest(secret_scan.KINDS, "s, k")} AS spans FROM every GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_entropy, 0)::BIGINT AS n_entropy FROM d LEFT JOIN agg USING (r)
"""


def op1() -> str:
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = (
        f"length({digits}) BETWEEN 16 AND 19 AND list_sum(list_transform(range(0, length({digits})), lambda i: "
        f"(1 + i % 2) * substr({digits}, (length({digits}) - i)::INT, 1)::INT - CASE WHEN i % 2 = 1 AND substr({digits}, (length({digits}) - i)::INT, 1)::INT > 4 THEN 9 ELSE 0 END)) % 10 = 0"
    )
    small = "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(p AS INT), 256) > 255 AND length(ltrim(p, '0')) > 0)) = 0"
    broader = f"CASE k WHEN 0 THEN regexp_extract(lower(m), '[^@]*$') WHEN 1 THEN regexp_extract(m, '^[0-9]+\\.[0-9]+') WHEN 2 THEN left({digits}, 6) ELSE left({digits}, 4) END"
    share = "log2(n * n_et / (n_e::DOUBLE * n_t)) / log2(n / n_e)"
    return rf"""
WITH {_ROWS},
base AS ({_matches("d", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true")} UNION ALL {_matches("d", 1, r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", small)}
  UNION ALL {_matches("d", 2, r"[0-9](?:[\x20-]?[0-9])+", luhn)} UNION ALL {_matches("d", 3, r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 8 AND 15")}),
entity AS (SELECT DISTINCT r, k || ':value:' || lower(m) AS entity FROM base UNION SELECT DISTINCT r, k || ':class:' || {broader} FROM base),
word AS (SELECT r, s, e, m AS term, left(m, {pii.STEM}) AS stem FROM ({_matches("d", 4, _WS, f"length(m) > 1 AND NOT contains(m, chr(65535))")}) w
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = w.r AND b.s < w.e AND b.e > w.s)),
raw AS (SELECT * FROM (SELECT DISTINCT r, unnest(regexp_extract_all(text, '{_WS}')) AS term FROM d) WHERE length(term) > 1),
of_token AS (SELECT 't' || term AS token, count(*) AS n_t FROM raw GROUP BY term UNION ALL SELECT 'c' || left(term, {pii.STEM}) AS token, count(DISTINCT r) FROM raw GROUP BY token),
of_entity AS (SELECT entity, count(*) AS n_e FROM entity GROUP BY entity),
token AS (SELECT DISTINCT r, 't' || term AS token FROM word UNION SELECT DISTINCT r, 'c' || stem FROM word),
joint AS (SELECT entity, token, count(*) AS n_et FROM entity JOIN token USING (r) GROUP BY entity, token),
total AS (SELECT count(*)::DOUBLE AS n, log2(greatest(1, (SELECT count(*) FROM of_token WHERE token[1] = 't' AND n_t > 1))) + {pii.SURE} AS chance FROM d),
strong AS (SELECT DISTINCT token FROM joint JOIN of_entity USING (entity) JOIN of_token USING (token), total WHERE n_e BETWEEN 2 AND n - 1 AND n_t > 1 AND {share} >= {pii.DISCLOSE} AND n_et * log2(n / n_e) >= chance),
hit AS (SELECT r, CASE WHEN 'c' || stem IN (SELECT token FROM strong) THEN 4 ELSE 5 END AS k, s, e, term FROM word WHERE 't' || term IN (SELECT token FROM strong)),
every AS (SELECT r, k, s, e, ['[EMAIL]', '[IP]', '[CARD]', '[PHONE]'][k + 1] AS label FROM base UNION ALL SELECT r, k, s, e, CASE k WHEN 4 THEN '[REMOVED]' ELSE left(term, {pii.STEM}) || '*' END FROM hit),
reach AS (SELECT *, coalesce(max(e) OVER (PARTITION BY r ORDER BY s, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM every),
clean AS (SELECT r, string_agg(substr(text, p + 1, greatest(s - p, 0)) || CASE WHEN s >= p THEN label ELSE '' END, '' ORDER BY s, k) || any_value(substr(text, last + 1)) AS clean
  FROM (SELECT *, max(e) OVER (PARTITION BY r) AS last FROM reach) JOIN d USING (r) GROUP BY r),
agg AS (SELECT r, {", ".join(f"count(*) FILTER (k = {i}) AS n_{n}" for i, n in enumerate(pii.KINDS))}, {_digest(pii.KINDS, "k, s")} FILTER (k < 4) AS base, {_digest(pii.KINDS, "k, s")} AS spans FROM every GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in pii.KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(coalesce(clean, text)) AS clean_sha256
FROM d LEFT JOIN agg USING (r) LEFT JOIN clean USING (r)
"""


def op2() -> str:
    span = len(decontam.MASKS[0])
    words = lambda table, key: f"SELECT *, regexp_extract_all(coalesce(text, ''), '{_WS}') AS w FROM (SELECT row_number() OVER () AS {key}, * FROM {table})"
    # each word with those that follow it, as many as a mask is long
    runs = lambda table, key: (
        f"SELECT {key}, p, w, list(w) OVER (PARTITION BY {key} ORDER BY p ROWS BETWEEN CURRENT ROW AND {span - 1} FOLLOWING) AS g FROM "
        f"(SELECT {key}, p, trim(lower(w), {_quoted(decontam.ENDS)}) AS w FROM (SELECT {key}, unnest(range(0, len(w))) AS p, unnest(w) AS w FROM {table}))"
    )
    seeds = lambda table: " UNION ALL ".join(
        f"SELECT *, {i} AS mask, concat_ws(' ', {', '.join(f'g[{j + 1}]' for j, c in enumerate(mask) if c == '1')}) AS seed FROM {table} WHERE len(g) = {span}" for i, mask in enumerate(decontam.MASKS)
    )
    return f"""
WITH d AS ({words("documents", "r")}), b AS ({words("benchmark", "q")} WHERE item_id IS NOT NULL),
dw AS ({runs("d", "r")}), bw AS ({runs("b", "q")}),
short AS (SELECT q, n, array_to_string(g, ' ') AS seed FROM bw JOIN (SELECT q, len(w) AS n FROM b) USING (q) WHERE p = 0 AND n < {span}),
hit AS (SELECT DISTINCT r, q, x.p - y.p AS x FROM ({seeds("dw")}) x JOIN ({seeds("bw")}) y USING (mask, seed)
  UNION SELECT DISTINCT r, q, p AS x FROM (SELECT dw.*, unnest(range(1, 1 + len(g))) AS n FROM dw) JOIN short USING (n) WHERE array_to_string(g[1 : n], ' ') = seed),
same AS (SELECT hit.r, hit.q, x, bw.p AS j FROM hit JOIN bw USING (q) JOIN dw ON dw.r = hit.r AND dw.p = bw.p + x AND dw.w = bw.w),
band AS (SELECT h.r, h.q, h.x, count(DISTINCT j) AS n, min(j) AS lo, max(j) AS hi FROM hit h JOIN same s ON s.r = h.r AND s.q = h.q AND abs(s.x - h.x) <= {decontam.BAND} GROUP BY ALL),
best AS (SELECT * FROM band QUALIFY row_number() OVER (PARTITION BY r, q ORDER BY n DESC, x) = 1)
SELECT doc_id, item_id, len(b.w)::BIGINT AS n_item_words, n::BIGINT AS n_matched, greatest(0, lo + x)::BIGINT AS start_word, least(len(d.w), hi + x + 1)::BIGINT AS end_word
FROM best JOIN d USING (r) JOIN b USING (q) WHERE 100 * n >= {decontam.PERCENT} * len(b.w)
"""
