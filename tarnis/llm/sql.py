"""The SQL that queries of this subpackage must agree with, where SQL can express them."""

from __future__ import annotations

from tarnis.llm import licenses, quality


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _chars(pattern: str) -> str:
    return f"length(regexp_replace(t, {_text(f'[^{pattern}]+')}, '', 'g'))"


_SPACE = r"[\x20\x09-\x0D]"

#: Failures of the rules, in their order, over the measurements.
_FAILS = [
    "n_words < 50", "100 * n_repeat_words > 50 * n_words", "n_words > 1000000", "n_symbols > 0.5 * n_words", "n_dup_lines > 0.6 * n_lines",
    "word_chars < 2 * n_words", "word_chars > 20 * n_words", "n_upper > 0.5 * n_letters", "n_digits > 0.3 * word_chars", "n_letters < 0.5 * word_chars",
    "n_exclamations > 0.3 * n_words", "n_bars > 0.2 * n_words", "n_words >= 50 AND n_distinct * 20 < sqrt(n_words) * 10", "n_ellipsis_lines > 0.5 * n_lines",
    "n_bullet_lines > 0.9 * n_lines", "n_replacement > 0.01 * word_chars",
]

QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, list_filter(string_split_regex(t, '{_SPACE}+'), lambda x: x <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM d
),
windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)
),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
),
m AS (
  SELECT w.doc_id, len(words) AS n_words, length(regexp_replace(t, '{_SPACE}+', '', 'g')) AS word_chars,
    {_chars("#*$%&|<>")} AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines, {_chars(chr(92) + "p{L}")} AS n_letters,
    {_chars(chr(92) + "p{Lu}")} AS n_upper, {_chars("0-9")} AS n_digits, {_chars("!")} AS n_exclamations, {_chars("|")} AS n_bars,
    len(list_distinct(words)) AS n_distinct,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…){_SPACE}*$'))) AS n_ellipsis_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '^{_SPACE}*[-*•] '))) AS n_bullet_lines,
    {_chars(chr(0xFFFD))} AS n_replacement
  FROM w LEFT JOIN covered USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, (failures & {quality.POLICIES[quality.CURRENT]}) = 0 AS kept, failures,
  {", ".join(c for c in quality.MEASURES if c not in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))}
FROM (SELECT *, {"(" + " + ".join(f"CASE WHEN {f} THEN {1 << i} ELSE 0 END" for i, f in enumerate(_FAILS)) + ")::BIGINT"} AS failures FROM m)
"""


def _rules(rules: list[licenses.Rule]) -> str:
    rows = (f"({r.number}, {_text(r.label)}, {r.priority}, {_text(f' {r.keyword} ')}, {_text(r.regex)})" for r in rules)
    return "(VALUES " + ", ".join(rows) + ") AS r(number, label, priority, keyword, regex)"


_FOUND = """
  SELECT doc_id, number, label, priority, regexp_extract(m, ':(\\d+) ', 1)::BIGINT AS start, regexp_extract(m, ':(\\d+) $', 1)::BIGINT AS last
  FROM (SELECT doc_id, number, label, priority, unnest(regexp_extract_all(placed, regex)) AS m FROM w JOIN {rules} ON contains(plain, keyword))
"""

LICENSES = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
w AS (
  SELECT doc_id, len(words) AS n_words, ' ' || array_to_string(words, ' ') || ' ' AS plain,
    array_to_string(list_transform(words, lambda x, i: ' ' || x || ':' || (i - 1) || ' '), '') AS placed
  FROM d
),
base AS ({_FOUND.format(rules=_rules(licenses.BASE_RULES))}),
found AS ({_FOUND.format(rules=_rules(licenses.RULES))}),
alive AS (
  SELECT * FROM found a WHERE NOT EXISTS (
    SELECT 1 FROM found b WHERE a.doc_id = b.doc_id AND b.start <= a.start AND b.last >= a.last AND (
      b.priority > a.priority OR (b.priority = a.priority AND (b.start < a.start OR b.last > a.last OR b.number < a.number)))
  )
),
b AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM alive) GROUP BY doc_id),
s AS (SELECT doc_id, max(CASE priority {" ".join(f"WHEN {p} THEN {c}" for p, c in licenses.CONFIDENCE.items())} END)::DOUBLE AS score FROM alive GROUP BY doc_id)
SELECT doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  greatest(coalesce(score, 0.0), CASE WHEN n_base > 0 THEN {licenses.CONFIDENCE[licenses.NAME]} ELSE 0.0 END)::DOUBLE AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id)
"""


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

#: Every document scored for every item over the terms that they share.
LEXICAL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS} AS words FROM documents),
sizes AS (SELECT r, doc_id, len(words)::BIGINT AS n FROM d WHERE len(words) > 0),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(words) AS term FROM d) GROUP BY r, term),
asked AS (SELECT item_id, term, count(*)::BIGINT AS repeats FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, totals),
impacts AS (
  SELECT tf.r, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms)) AS impact
  FROM tf JOIN sizes USING (r), totals
),
scores AS (
  SELECT item_id, r, doc_id, sum(repeats * w * impact)::BIGINT AS score
  FROM asked JOIN w USING (term) JOIN impacts USING (term) GROUP BY item_id, r, doc_id
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM scores WHERE score > 0
) WHERE rank <= 10
"""

_DISTANCE = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
_NEAREST = f"""
a{{i}} AS MATERIALIZED (
  SELECT r, v, arg_min(cluster, [d, cluster]) AS cluster, min(d) AS d FROM (SELECT r, v, cluster, {_DISTANCE}::BIGINT AS d FROM x, c{{i}}) GROUP BY r, v
)"""
_MEANS = """
m{i} AS (
  SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY dim) AS c
  FROM (SELECT cluster, dim, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS dim FROM a{i}) GROUP BY cluster, dim)
  GROUP BY cluster
),
c{j} AS MATERIALIZED (SELECT c{i}.cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))"""

#: Ten rounds written out one after another.
CENTROIDS = f"""
WITH x AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64 AND len(embedding) = 64
),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY h NULLS LAST, v) - 1)::INTEGER AS cluster, v AS c
  FROM (SELECT sha256('3:' || vec_id) AS h, v FROM x ORDER BY h NULLS LAST, v LIMIT 8)
),
{",".join(_NEAREST.format(i=i) + "," + _MEANS.format(i=i, j=i + 1) for i in range(10))},
{_NEAREST.format(i=10)}
SELECT vec_id, a10.cluster, d AS distance, (sum(d) OVER (PARTITION BY a10.cluster))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a10 JOIN x USING (r) JOIN c10 ON a10.cluster = c10.cluster
"""

#: Every query against every other row.
VECTORS = """
WITH x AS (
  SELECT vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = len(embedding)
),
pairs AS (
  SELECT q.vec_id AS query_id, x.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM x AS q JOIN x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id AND len(q.v) = len(x.v)
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs
) WHERE rank <= 5
"""
