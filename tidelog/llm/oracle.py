"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tidelog.llm.licenses import LEVELS, PHRASES, compiled
from tidelog.llm.templates import TEMPLATES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACED = r"[^\x20\x09-\x0D]+"
ALPHA = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

OP1 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{SPACED}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * i >= 85 * (u.c + v.c - i)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT doc_id, coalesce(c, 0) AS n_shingles, least_id AS component_id, doc_id = least_id AS kept
FROM (SELECT x, min(y) AS least_id FROM r GROUP BY x) m JOIN d ON d.doc_id = m.x LEFT JOIN n USING (doc_id)"""

OP4 = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d) x),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM g) x WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(20)) AS k FROM r),
k AS (SELECT doc_id, list_sort(list(k)) AS ks FROM gone GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
kept AS (SELECT words.doc_id, array_to_string(list(word ORDER BY words.k), ' ') AS t FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.k = words.k WHERE gone.k IS NULL GROUP BY words.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(len(ks), 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id) LEFT JOIN kept USING (doc_id)"""

#: The rules, in the order of their bits.
RULES = {
    "few_words": "n_words < 50",
    "repeated_triples": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 20 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_lines",
    "no_words": "n_words = 0",
}
#: What policy v1 asks of the measurements: all of them.
V1 = " OR ".join(RULES.values())
BITS = " + ".join(f"CASE WHEN {r} THEN {1 << i} ELSE 0 END" for i, r in enumerate(RULES.values()))
MEASURED = f"""d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d) x),
often AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) x WHERE n > 1),
hit AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS k FROM often) x GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
 len(list_filter(lines, lambda x: regexp_matches(x, '{SPACED}'))) - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '{SPACED}')))) AS n_dup_lines, coalesce(hit.n, 0) AS n_repeat_words FROM d LEFT JOIN hit USING (doc_id)),
f AS (SELECT *, {BITS} AS failures FROM m)"""
OP8 = f"""WITH {MEASURED}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT ({V1}) AS kept, failures::BIGINT AS failures FROM f"""
ABLATIONS = f"WITH {MEASURED} " + " UNION ALL ".join(
    f"SELECT '{name}' AS rule, count(*) FILTER ({rule}) AS fails, count(*) FILTER (({rule}) AND NOT ({others})) AS alone, count(*) FILTER (NOT ({others})) AS without FROM f"
    for name, rule in RULES.items()
    for others in [" OR ".join(r for n, r in RULES.items() if n != name)]
)


def words_sql(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


PLACES = " UNION ALL ".join(f"SELECT doc_id, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i:i + {len(p.split()) - 1}] = {words_sql(p.split())})) - 1 AS k, '{label}' AS label FROM d" for p, label in PHRASES.items())
SETS = ", ".join(f"('{t.label}', '{t.family}', {t.level}, {t.least}, {words_sql(sorted(t.must))}, {words_sql(sorted(t.words))})" for t in compiled(TEMPLATES))
BLOCKS = " UNION ALL ".join(f"SELECT doc_id, {x} AS level, k AS block, list_distinct(w[k * {x} + 1:(k + 2) * {x}]) AS b FROM (SELECT doc_id, w, unnest(range(0, (len(w) + {x - 1}) // {x})) AS k FROM d) x" for x in LEVELS)
OP5 = f"""WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{ALPHA}') AS w FROM documents),
places AS ({PLACES}),
base AS (SELECT doc_id, count(*) AS n_base, min(k) AS first_word, max(k) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM places GROUP BY doc_id),
blocks AS ({BLOCKS}),
held AS (SELECT doc_id, level, block, label, family, len(list_intersect(b, s)) AS n, len(s) AS size FROM blocks JOIN (VALUES {SETS}) AS v(label, family, level, least, must, s) USING (level) WHERE len(b) >= least AND list_has_all(b, must) AND len(list_intersect(b, s)) >= least),
found AS (SELECT doc_id, label, n / size AS c FROM held QUALIFY n = max(n) OVER (PARTITION BY doc_id, level, block, family)),
best AS (SELECT doc_id, max(c) AS c, list_distinct(list(label)) AS labels FROM found GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(coalesce(base.labels, []), ',') AS base_labels,
 array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(best.labels, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id)"""

ORACLE_SQL = {"op1_near_duplicates": OP1, "op4_repeated_passages": OP4, "op5_license_scan": OP5, "op8_quality_ledger": OP8, "quality_ablations": ABLATIONS}
