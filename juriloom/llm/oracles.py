"""DuckDB SQL for the operators that SQL can express, over the same whole tables."""
from __future__ import annotations

from .line_dedup import ORACLE as LINE_DEDUP
from .quality_rules import COMMON_WORDS

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_CLASSES = [r"[^a-z]", r"[^\x20\x09-\x0D]", r"[\x00-\x7F]", r"[^A-Z]", r"[^0-9]", r"[^.,;:?''" + '"' + r"()\-]"]
_COUNTS = ", ".join(f"length(regexp_replace(t, '{c}', '', 'g'))::DOUBLE" for c in _CLASSES)
_COMMON = "[" + ", ".join(f"'{w}'" for w in COMMON_WORDS) + "]"
_N = len(COMMON_WORDS) + 1


def _distance(p: str, q: str) -> str:
    pairs = f"list_zip(list_transform({p}, lambda x: x / greatest(list_sum({p}), 1)), list_transform({q}, lambda x: x / greatest(list_sum({q}), 1)))"
    part = "CASE WHEN {x} > 0 THEN {x} * log2({x} / ((z[1] + z[2]) / 2)) ELSE 0 END"
    return f"sqrt(greatest(list_sum(list_transform({pairs}, lambda z: 0.5 * ({part.format(x='z[1]')} + {part.format(x='z[2]')}))), 0))"


QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, {WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, i, k, count(*) OVER (PARTITION BY doc_id, k) AS n FROM (SELECT doc_id, i, array_to_string(w[i:i + 2], chr(1)) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3))),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY doc_id),
c AS (SELECT doc_id, lang, t, len(w) AS n_words, length(t) - length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, [{_COUNTS}] AS cc, list_transform({_COMMON}, lambda x: len(list_filter(w, lambda y: y = x))::DOUBLE) AS wc FROM d LEFT JOIN r USING (doc_id)),
h AS (SELECT * EXCLUDE (cc, wc), list_append(cc, length(t) - list_sum(cc)) AS cc, list_append(wc, n_words - list_sum(wc)) AS wc FROM c),
ref AS (SELECT lang, [{", ".join(f"sum(cc[{i}])" for i in range(1, 8))}] AS cr, [{", ".join(f"sum(wc[{i}])" for i in range(1, _N + 1))}] AS wr FROM (SELECT * FROM h QUALIFY (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) = min(n_words < 50 OR 100 * n_repeat_words > 50 * n_words) OVER (PARTITION BY lang)) GROUP BY lang),
f AS (SELECT h.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CASE WHEN length(t) >= 300 THEN {_distance("cc", "cr")} ELSE 0 END AS dc, CASE WHEN n_words >= 120 THEN {_distance("wc", "wr")} ELSE 0 END AS dw FROM h JOIN ref ON h.lang IS NOT DISTINCT FROM ref.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND dc <= 0.3 AND dw <= 0.28 AS kept FROM f
"""

SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT k, min(doc_id) AS first FROM s GROUP BY k),
g AS (SELECT doc_id, list(p) AS p FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM s JOIN f USING (k) WHERE doc_id > first) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(p), 0) AS n_removed, sha256(array_to_string(CASE WHEN p IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(p, i)) END, ' ')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM d WHERE len(w) > 0),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
adjacent AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT a AS x, b AS y FROM adjacent UNION SELECT r.x, b.b FROM reach r JOIN adjacent b ON b.a = r.y)
SELECT d.doc_id, coalesce(len(s), 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id <= coalesce(m, d.doc_id) AS kept FROM d LEFT JOIN s USING (doc_id) LEFT JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) r ON r.x = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": LINE_DEDUP, "op3_quality_rules": QUALITY_RULES, "op5_substring_dedup": SUBSTRING_DEDUP, "op7_near_duplicates": NEAR_DUPLICATES}
