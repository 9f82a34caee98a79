"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import exact_dedup, language_id, mixing, ngram_join, packing, quality, sanitise, sharding, substring_dedup, token_counts

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_mixing": mixing.op2_mixing,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_language_id": language_id.op4_language_id,
    "op5_packing": packing.op5_packing,
    "op6_quality": quality.op6_quality,
    "op7_sharding": sharding.op7_sharding,
    "op8_sanitise": sanitise.op8_sanitise,
    "op9_ngram_join": ngram_join.op9_ngram_join,
    "op10_token_counts": token_counts.op10_token_counts,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"

NGRAM_JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.y FROM reach JOIN links ON reach.b = links.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""


def _kind(pattern: str) -> str:
    return f"length(regexp_replace(t, '[^{pattern}]', '', 'g'))"


_TERM = "CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END"
_DISTANCE = "SELECT doc_id, sqrt(greatest(0, sum(" + _TERM.format(x="a", y="b") + " + " + _TERM.format(x="b", y="a") + ") / 2)) AS d FROM (SELECT doc_id, n / nullif(sum(n) OVER (PARTITION BY doc_id), 0) AS a, r / nullif(sum(r) OVER (PARTITION BY doc_id), 0) AS b FROM {rows}) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY doc_id"

QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
kinds AS (
  SELECT doc_id, lang, length(t) AS n_chars, {_kind(r"\p{Lu}")} AS up, {_kind(r"\p{Nd}")} AS digit, {_kind(r"\x20\x09-\x0D")} AS space, {_kind(r"\p{P}")} - {_kind("#*%&")} AS punct, {_kind("#*$%&|<>")} AS symbol FROM d
),
kind_rows AS (SELECT doc_id, lang, unnest([1, 2, 3, 4, 5, 6]) AS k, unnest([up, digit, space, punct, symbol, n_chars - up - digit - space - punct - symbol]) AS n FROM kinds),
kind_both AS (SELECT doc_id, k, n, sum(n) OVER (PARTITION BY lang, k) AS r FROM kind_rows),
kind_distance AS ({_DISTANCE.format(rows="kind_both")}),
words AS (SELECT doc_id, lang, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
common AS (
  SELECT lang, lower(word) AS word FROM words WHERE length(lower(word)) <= 5 AND regexp_full_match(lower(word), '\\p{{L}}+') GROUP BY lang, lower(word)
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, lower(word)) <= 16
),
hits AS (SELECT doc_id, lower(word) AS word, count(*) AS n FROM words WHERE length(word) <= 5 GROUP BY ALL),
known AS (SELECT d.doc_id, d.lang, c.word, coalesce(h.n, 0) AS n FROM d JOIN common c USING (lang) LEFT JOIN hits h ON h.doc_id = d.doc_id AND h.word = c.word),
other AS (SELECT d.doc_id, d.lang, '' AS word, len(d.w) - coalesce(sum(k.n), 0) AS n FROM d LEFT JOIN known k USING (doc_id) GROUP BY d.doc_id, d.lang, len(d.w)),
word_both AS (SELECT doc_id, n, sum(n) OVER (PARTITION BY lang, word) AS r FROM (FROM known UNION ALL FROM other)),
word_distance AS ({_DISTANCE.format(rows="word_both")}),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM d),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(0, 8)) AS j) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, {_WORDS}) GROUP BY doc_id),
base AS (
  SELECT d.doc_id, len(w) AS n_words, n_chars - space AS word_chars, symbol AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, n_chars, coalesce(kd.d, 0) AS kd, coalesce(wd.d, 0) AS wd
  FROM d JOIN kinds USING (doc_id) LEFT JOIN lines ON lines.doc_id = d.doc_id LEFT JOIN covered ON covered.doc_id = d.doc_id LEFT JOIN kind_distance kd ON kd.doc_id = d.doc_id LEFT JOIN word_distance wd ON wd.doc_id = d.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (n_chars >= {quality.LEAST_CHARACTERS} AND kd > {quality.CHARACTER_DISTANCE}) AND NOT (n_words >= {quality.LEAST_COMMON_WORDS} AND wd > {quality.WORD_DISTANCE}) AS kept
FROM base
"""

SQL = {
    "op3_exact_dedup": exact_dedup.SQL,
    "op6_quality": QUALITY,
    "op9_ngram_join": NGRAM_JOIN,
}
