"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .quality import QualityRules

WORD = r"[^\x20\x09-\x0D]+"
NORMAL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SUBSTRING = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
f AS (SELECT win, min(doc_id) AS first FROM w GROUP BY win HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM w JOIN f USING (win) WHERE doc_id > first),
k AS (SELECT d.doc_id, p.i, d.ws[p.i] AS word FROM d, LATERAL (SELECT unnest(range(1, len(d.ws) + 1)) AS i) p WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = d.doc_id AND g.k = p.i)),
s AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)
"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{NORMAL}') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{NORMAL}') AS ws FROM benchmark),
v AS (SELECT DISTINCT item, n, array_to_string(ws[i:i+n-1], ' ') AS win FROM (SELECT item, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
x AS (SELECT DISTINCT n FROM v),
w AS (SELECT doc_id, n, i, array_to_string(ws[i:i+n-1], ' ') AS win FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, x WHERE len(ws) >= n)),
h AS (SELECT w.doc_id, w.n, w.i, v.item FROM w JOIN v USING (n, win)),
c AS (SELECT doc_id, count(DISTINCT k) AS hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(hit, 0) AS n_hit, coalesce(items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def quality(rules: QualityRules = QualityRules()) -> str:
    def grams(n: int) -> str:
        return f"""w{n} AS (SELECT doc_id, i, array_to_string(ws[i:i+{n - 1}], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM d WHERE len(ws) >= {n})),
c{n} AS (SELECT doc_id, count(*) AS words, sum(len(ws[k])) AS chars FROM (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS k FROM w{n} JOIN (SELECT doc_id, win FROM w{n} GROUP BY ALL HAVING count(*) > 1) USING (doc_id, win)) JOIN d USING (doc_id) GROUP BY doc_id)"""

    sizes = [n for n, _ in rules.ngram_limits]
    chars = [f"CAST(coalesce(c{n}.chars, 0) AS BIGINT)" for n in sizes]
    inside = " AND ".join(f"coalesce(c{n}.chars, 0) <= {limit}e0 * word_chars" for n, limit in rules.ngram_limits)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: len(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols FROM d),
l AS (SELECT doc_id, line, count(*) AS n, CAST(list_sum(list_transform(regexp_extract_all(line, '{WORD}'), lambda x: len(x))) AS BIGINT) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id, line),
e AS (SELECT doc_id, CAST(sum(n - 1) AS BIGINT) AS n_dup_lines, CAST(sum((n - 1) * chars) AS BIGINT) AS dup_line_chars FROM l GROUP BY doc_id),
{", ".join(grams(n) for n in [3, *sizes])},
r AS (SELECT m.*, coalesce(e.n_dup_lines, 0) AS n_dup_lines, coalesce(c3.words, 0) AS n_repeat_words, coalesce(e.dup_line_chars, 0) AS dup_line_chars, concat_ws(',', {", ".join(chars)}) AS dup_ngram_chars,
  n_words < {rules.min_words} OR coalesce(c3.words, 0) > {rules.max_repeat_share}e0 * n_words AS base_failed,
  coalesce(e.dup_line_chars, 0) <= {rules.line_limit}e0 * word_chars AND n_symbols <= {rules.symbol_limit}e0 * n_words AND {inside} AS fine
  FROM m LEFT JOIN e USING (doc_id) LEFT JOIN c3 USING (doc_id) {" ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in sizes)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, dup_line_chars, dup_ngram_chars, NOT base_failed AND fine AS kept FROM r
"""


#: Control strings by their first character, as they count when escaped: one more code point each.
_MARKS = r"len(regexp_extract_all(t, '<\\*(?:\|turn\|>|\|text\|>|\|end\|>|s>|/s>|\|im_start\|>|\|im_end\|>|\|endoftext\|>)')) + len(regexp_extract_all(t, '\[\\*(?:INST\]|/INST\])'))"

CHAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
  CAST(coalesce(sum(len(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(23 + len(r) + len(regexp_extract_all(r, '[<\\\\]')) + len(t) + {_MARKS}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

LINES = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
n AS (SELECT doc_id, i, ls[i] AS line, len(regexp_extract_all(ls[i], '{WORD}')) AS k FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
r AS (SELECT n.doc_id, n.i, z.len, array_to_string(list_slice(d.ls, n.i, n.i + z.len - 1), chr(10)) AS run FROM n JOIN d USING (doc_id), (SELECT unnest([1, 2, 3, 4, 5]) AS len) z
  WHERE n.i + z.len - 1 <= len(d.ls) AND (SELECT min(m.k) > 0 AND sum(m.k) >= 5 FROM n m WHERE m.doc_id = n.doc_id AND m.i BETWEEN n.i AND n.i + z.len - 1)),
f AS (SELECT len, run, min(struct_pack(a := doc_id, b := i)) AS first FROM r GROUP BY len, run HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + len)) AS i FROM r JOIN f USING (len, run) WHERE struct_pack(a := doc_id, b := i) > first),
s AS (SELECT n.doc_id, count(*) FILTER (k > 0) AS n_lines, count(g.i) AS n_removed, string_agg(line, chr(10) ORDER BY n.i) FILTER (g.i IS NULL) AS kept FROM n LEFT JOIN g USING (doc_id, i) GROUP BY n.doc_id)
SELECT s.doc_id, n_lines, n_removed, CASE WHEN o.text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text FROM s JOIN documents o USING (doc_id)
"""


#: Bytes of code points below 2048 in UTF-8; then CRC-32 by bits: each byte is mixed in and followed by eight shifts (-1).
_BYTES = "flatten(list_transform(string_split(key, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(192 + (unicode(c) >> 6) AS BIGINT), CAST(128 + (unicode(c) & 63) AS BIGINT)] END))"
_STEPS = f"flatten(list_transform({_BYTES}, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1]))"
_CRC = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_STEPS}), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END), CAST(4294967295 AS BIGINT))"

SPELLING = f"""
WITH RECURSIVE r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')), '{UPPER}', '{LOWER}') AS run FROM documents),
k AS (SELECT run, id || ':' || run AS key, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT run, n, {_CRC} AS h FROM k),
c AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY word HAVING length(word) >= 7 AND sum(n) >= 2),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
g AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS wild, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM p),
x AS (SELECT a.word, b.word AS other, b.n AS other_n FROM g a JOIN g b ON a.wild = b.wild AND a.word <> b.word),
y AS (SELECT DISTINCT g.word, g.n, v.word AS other, v.n AS other_n FROM g JOIN v ON g.cut = v.word),
e AS (SELECT * FROM x UNION ALL SELECT word, other, other_n FROM y UNION ALL SELECT other, word, n FROM y),
b AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS best, max(other_n) AS best_n FROM e GROUP BY word),
f AS MATERIALIZED (SELECT v.word, v.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN best_n >= 10 * v.n THEN best END AS form, CASE WHEN best_n >= 10 * v.n THEN best_n END AS form_n FROM v LEFT JOIN b USING (word)),
t AS (SELECT word, word AS here, 0 AS step FROM f UNION ALL SELECT t.word, f.form, step + 1 FROM t JOIN f ON t.here = f.word WHERE f.form IS NOT NULL),
z AS (SELECT word, arg_max(here, step) AS root FROM t GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN z USING (word)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": LINES, "op6_substring_dedup": SUBSTRING, "op7_quality_rules": quality(), "op8_chat_formatting": CHAT, "op10_decontamination": DECONTAMINATION, "op11_spelling_variants": SPELLING}
