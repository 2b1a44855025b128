"""The SQL that DuckDB runs for the operators that it can express.

There is none for sharding and packing (DuckDB has no crc32), quality rules (quantile sketches), language ID and the classifier (learned); tests hold those against plain Python.
"""

from __future__ import annotations

from . import decontam as D
from . import secrets as S

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _matches(pattern: str) -> str:
    """Matches of the text t with their places: the pieces between the matches and the matches add up."""
    p = _quoted(pattern)
    before = f"list_sum(list_transform(string_split_regex(t, {p})[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(t, {p})[1:i - 1], lambda x: length(x))), 0)"
    return f"list_transform(generate_series(1, len(regexp_extract_all(t, {p}))), lambda i: {{'start': {before}, 'm': regexp_extract_all(t, {p})[i]}})"


def _spans(kind: int, found: str, condition: str = "true") -> str:
    return f"list_transform(list_filter({found}, lambda f: {condition}), lambda f: {{'start': f.start::BIGINT, 'kind': {kind}, 'stop': (f.start + length(f.m))::BIGINT}})"


def _secrets() -> str:
    like = lambda x, p: f"regexp_matches({x}, {_quoted(p)})"
    window = f"substr(f.m, i, {S.WINDOW})"
    least = "CASE " + " ".join(f"WHEN {like('f.m', p)} THEN {bits}" for _, p, bits in S.CLASSES) + " END"
    hits = f"{like(window, '[0-9]')} AND {like(window, '[A-Za-z]')} AND list_aggregate(string_split({window}, ''), 'entropy') >= {least}"
    dense = f"NOT ({' OR '.join(like('f.m', p) for p in S.ALLOW)}) AND len(list_filter(generate_series(1, length(f.m) - {S.WINDOW - 1}), lambda i: {hits})) > 0"
    free = "len(list_filter(base, lambda b: b.start <= f.start AND b.stop >= f.start + length(f.m))) = 0"
    text = lambda s: f"array_to_string(list_transform({s}, lambda s: {list(S.KINDS)}[s.kind + 1] || ':' || s.start || ':' || s.stop), ',')"
    count = lambda k: f"len(list_filter(base, lambda s: s.kind = {k}))"
    value = f"length(regexp_extract(f.m, {_quoted(S.ASSIGN)}, 2)) >= {S.ASSIGN_VALUE}"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, {_matches(S.ASSIGN)} AS a, {_matches("AKIA[A-Z0-9]+")} AS k, {_matches(S.HEX)} AS h, {_matches(S.CANDIDATE)} AS c FROM d),
b AS (SELECT doc_id, c, list_sort(list_concat({_spans(0, "a", value)}, {_spans(1, "k", "length(f.m) >= 18")}, {_spans(2, "h")})) AS base FROM f),
e AS (SELECT doc_id, base, list_sort(list_concat(base, {_spans(3, "c", f"{dense} AND {free}")})) AS spans FROM b)
SELECT doc_id, {count(0)} AS n_assign, {count(1)} AS n_access, {count(2)} AS n_hex, sha256({text("base")}) AS base_sha256, {text("spans")} AS spans FROM e"""


ORACLE_SQL = {
    "op2_secret_scans": _secrets(),
    "op3_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS p FROM d WHERE length(h) >= 200)),
r AS (SELECT doc_id, p, p + 100 AS e FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
m AS (SELECT doc_id, p, e, max(e) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM r),
i AS (SELECT doc_id, p, e, sum(CASE WHEN prev IS NULL OR p > prev THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM m),
spans AS (SELECT doc_id, min(p) AS a, max(e) AS b FROM i GROUP BY doc_id, g),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM spans UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * x + 1, 2 * (coalesce(y, length(h) // 2) - x)), '' ORDER BY x) AS k FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, (length(h) - length(coalesce(k, h))) // 2 AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op4_decontamination": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
items AS (SELECT DISTINCT item_id, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS k, least(len(w), 13) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM items),
places AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) CROSS JOIN sizes WHERE i + n - 1 <= len(w)),
hits AS (SELECT doc_id, i, p.n, item_id FROM places p JOIN items USING (k, n)),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY 1),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS s FROM hits GROUP BY 1),
tokens AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
counts AS (SELECT x, count(*) AS c FROM tokens GROUP BY 1),
wins AS (SELECT k, list(DISTINCT item_id) AS who, any_value(string_split(k, ' ')) AS t FROM items GROUP BY k),
rarest AS (SELECT k, arg_min(x, c) AS x FROM (SELECT k, unnest(list_distinct(t)) AS x FROM wins) LEFT JOIN counts USING (x) GROUP BY k HAVING count(c) = count(*)),
around AS (SELECT doc_id, who, t, len(t) + {D.SLOP} AS n, d.w[greatest(1, p - len(t) - {D.SLOP - 1}):p + len(t) + {D.SLOP - 1}] AS a FROM rarest JOIN wins USING (k) JOIN tokens USING (x) JOIN d USING (doc_id)),
close AS (SELECT doc_id, who FROM around WHERE list_has_all(a, t) AND len(list_filter(range(1, greatest(len(a) - n + 1, 1) + 1), lambda i: len(list_filter(list_distinct(t), lambda y:
  len(list_filter(a[i:i + n - 1], lambda z: z = y)) < len(list_filter(t, lambda z: z = y)))) = 0)) > 0),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM (SELECT doc_id, unnest(who) AS item_id FROM close) GROUP BY 1)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN near USING (doc_id)""",
    "op7_ngram_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] END) AS x FROM d),
e AS (SELECT doc_id, len(x) AS n, unnest(x) AS g FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n) AS n, any_value(b.n) AS m FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 90 * greatest(a.n, b.n) <= 100 * least(a.n, b.n) GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * common >= 90 * (n + m - common)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)
SELECT s.doc_id, len(x)::BIGINT AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id FROM s LEFT JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, x""",
    "op9_url_filters": """
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
f AS (SELECT page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(verdict, length(r.host || r.path)) AS verdict
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (page_id)""",
}
