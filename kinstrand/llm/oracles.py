"""DuckDB SQL for the queries that SQL can express; the tests hold the others against plain Python versions."""

from __future__ import annotations

from kinstrand.llm.licenses import CONTAINMENT, PHRASES, TEMPLATES, block_words

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP1 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d),
dup AS (
  SELECT doc_id, s FROM (
    SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(w[s : s + 19], ' ') ORDER BY doc_id, s) AS n FROM win
  ) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, s + o AS p FROM dup, range(0, 20) AS t(o)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT word.doc_id, count(gone.p) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY word.p) FILTER (gone.p IS NULL), '') AS t
  FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_OP4 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
gram AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS s FROM d),
rep AS (
  SELECT DISTINCT doc_id, s + o AS p FROM (
    SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, w[s], w[s + 1], w[s + 2]) AS n FROM gram
  ), range(0, 3) AS t(o) WHERE n > 1),
cnt AS (SELECT doc_id, count(*) AS n FROM rep GROUP BY 1),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(cnt.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cnt USING (doc_id)),
f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN n_lines >= 4 AND 10 * n_dup_lines > 5 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END)::BIGINT AS failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""

_STRIP = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_OP8 = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS p FROM documents),
k AS (SELECT *, translate(trim(x, {_STRIP}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
shared AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.*, shared.first IS NOT NULL AND shared.first <> doc_id AS gone FROM k LEFT JOIN shared USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(x, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


def _op10() -> str:
    tokens = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    phrases = " UNION ALL ".join(
        f"SELECT doc_id, s - 1 AS place, '{label}' AS label, 1.0 AS score FROM p WHERE " + " AND ".join(f"w[s + {i}] = '{x}'" for i, x in enumerate(phrase.split())) for phrase, label in PHRASES.items()
    )
    rows = ", ".join(f"('{label}', [{', '.join(repr(x) for x in sorted(set(t.split())))}], {block_words(t)})" for t, label in TEMPLATES.items())
    return f"""
WITH d AS (SELECT doc_id, {tokens.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM d),
base AS ({phrases}),
t AS (SELECT label, len(need) AS size, block, unnest(need) AS x FROM (VALUES {rows}) AS v(label, need, block)),
hit AS (SELECT doc_id, s, label, size, block, x FROM (SELECT doc_id, s, w[s] AS x FROM p) JOIN t USING (x)),
near AS (
  SELECT a.doc_id, NULL::BIGINT AS place, a.label, count(DISTINCT b.x) / a.size AS score
  FROM hit a JOIN hit b ON a.doc_id = b.doc_id AND a.label = b.label AND b.s >= a.s AND b.s < a.s + a.block
  GROUP BY a.doc_id, a.label, a.size, a.s HAVING count(DISTINCT b.x) >= ceil({CONTAINMENT} * a.size - 1e-9)),
a AS (SELECT * FROM base UNION ALL SELECT * FROM near),
g AS (
  SELECT doc_id, count(place) AS n, min(place) AS f, max(place) AS l, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (place IS NOT NULL) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM a GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, f::BIGINT AS first_word, l::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN g USING (doc_id)
"""


_FIELDS = " || ".join(f"CASE WHEN {{{c}}} IS NULL THEN '-' ELSE strlen({{{c}}}::VARCHAR) || ':' || {{{c}}}::VARCHAR END" for c in ("doc_id", "source", "lang", "n_chars", "text"))
_LEAF = _FIELDS.format(**{c: c for c in ("doc_id", "source", "lang", "n_chars", "text")})
_CHANGED = _FIELDS.format(**{c: c for c in ("doc_id", "source", "lang", "text")}, n_chars="(n_chars::HUGEINT + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END)")
_SIBLING = "{n}.t = {f}.t AND {n}.lvl = {f}.lvl AND {n}.idx = xor({f}.idx, 1)"
_FOLD = "sha256(CASE WHEN {n}.h IS NULL THEN {f}.h WHEN {f}.idx % 2 = 1 THEN {n}.h || {f}.h ELSE {f}.h || {n}.h END)"
_OP12 = f"""
WITH RECURSIVE crcs AS (
  SELECT list(list_reduce(list_concat([i::BIGINT], range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)),
c AS (
  SELECT row_number() OVER () AS rid, documents.*,
    xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, crcs.t[(xor(a, b) & 255) + 1]))) AS crc
  FROM documents, crcs),
l AS (
  SELECT rid, doc_id, lang, sha256({_LEAF}) AS leaf, sha256({_CHANGED}) AS other FROM c),
g AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS t, count(*) OVER () AS trees FROM (SELECT DISTINCT lang FROM l)),
p AS (
  SELECT l.*, g.t, trees, row_number() OVER (PARTITION BY g.t ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS idx, count(*) OVER (PARTITION BY g.t) AS n
  FROM l JOIN g ON l.lang IS NOT DISTINCT FROM g.lang),
node(t, lvl, idx, h, n) AS (
  SELECT t, 0, idx, leaf, n FROM p
  UNION ALL SELECT t, lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), any_value((n + 1) // 2) FROM node WHERE n > 1 GROUP BY t, lvl, idx // 2),
sub AS (SELECT t, h FROM node WHERE n = 1),
upper_(t, lvl, idx, h, n) AS (
  SELECT 0, 0, t, h, (SELECT count(*) FROM sub) FROM sub
  UNION ALL SELECT 0, lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), any_value((n + 1) // 2) FROM upper_ WHERE n > 1 GROUP BY lvl, idx // 2),
f(rid, t, lvl, idx, h, proof, n) AS (
  SELECT rid, t, 0, idx, other, '', n FROM p
  UNION ALL SELECT f.rid, f.t, f.lvl + 1, f.idx // 2, {_FOLD.format(n="node", f="f")}, f.proof || coalesce(node.h, ''), (f.n + 1) // 2
  FROM f LEFT JOIN node ON {_SIBLING.format(n="node", f="f")} WHERE f.n > 1),
f2(rid, t, lvl, idx, h, proof, n) AS (
  SELECT f.rid, 0, 0, f.t, f.h, f.proof, trees FROM f JOIN g USING (t) WHERE f.n = 1
  UNION ALL SELECT f2.rid, 0, f2.lvl + 1, f2.idx // 2, {_FOLD.format(n="upper_", f="f2")}, f2.proof || coalesce(upper_.h, ''), (f2.n + 1) // 2
  FROM f2 LEFT JOIN upper_ ON {_SIBLING.format(n="upper_", f="f2")} WHERE f2.n > 1),
top AS (SELECT h AS root FROM upper_ WHERE n = 1)
SELECT doc_id, leaf, sub.h AS subroot, root, sha256(f2.proof) AS proof_sha256, f2.h AS folded_root, f2.h = root AS verified
FROM p JOIN f2 USING (rid) JOIN sub ON sub.t = p.t, top WHERE f2.n = 1
"""


SQL: dict[str, str] = {
    "op1_substring_dedup": _OP1, "op4_quality_rules": _OP4, "op8_line_dedup": _OP8, "op10_license_scan": _op10(), "op12_merkle_manifest": _OP12,
}
