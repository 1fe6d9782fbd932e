"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_GAPS = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORD = r"'[^\x20\x09-\x0D]+'"

OP1 = f"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
t AS (SELECT *, trim(line, {_GAPS}) AS own FROM l),
b AS (SELECT own FROM t WHERE own <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 10),
m AS (SELECT t.*, b.own IS NOT NULL AS gone FROM t LEFT JOIN b ON t.own = b.own)
SELECT doc_id, count(*) FILTER (own <> '') AS n_lines, count(*) FILTER (gone) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""

OP4 = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {_GAPS}) <> '') AS ls FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+2], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM n, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY 1),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(len(regexp_extract_all(t, '\\p{{Lu}}{{2,}}')) AS BIGINT) AS n_upper_runs FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
f AS (SELECT *, n_words < 50 AS f0, 100 * n_repeat_words > 50 * n_words AS f1, 10 * n_symbols > n_words AS f2, 2 * n_dup_lines > n_lines AS f3,
    word_chars < 3 * n_words AS f4, word_chars > 12 * n_words AS f5, 2 * n_upper_runs > n_words AS f6 FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper_runs,
  CAST({" + ".join(f"{1 << i} * CAST(f{i} AS INT)" for i in range(7))} AS BIGINT) AS failed_bits,
  f0 OR f1 AS base_failed, NOT ({" OR ".join(f"f{i}" for i in range(7))}) AS kept FROM f
"""

_POLICIES = {"base": ("few_words", "repeated_windows"), "standard": ("few_words", "repeated_windows", "many_symbols", "duplicate_lines", "short_words", "long_words", "shouting")}
ABLATIONS = f"WITH q AS ({OP4}) " + " UNION ALL ".join(
    f"""SELECT '{name}' AS policy, CAST(1 AS INT) AS version, count(*) AS n_docs, bit_or(failed_bits) AS all_bits, bit_and(failed_bits) AS common_bits, '{rule}' AS rule,
  count(*) FILTER (failed_bits & {1 << i} <> 0) AS n_failed, count(*) FILTER (failed_bits & {(1 << len(rules)) - 1} = {1 << i}) AS n_only FROM q"""
    for name, rules in _POLICIES.items()
    for i, rule in enumerate(rules)
)

OP10 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+49], ' ') AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
f AS (SELECT h, min(doc_id) AS f FROM g GROUP BY h),
b AS (SELECT doc_id, i FROM g JOIN f ON g.h = f.h WHERE f.f < doc_id),
x AS (SELECT DISTINCT doc_id, i + k AS i FROM b, (SELECT unnest(range(50)) AS k)),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
k AS (SELECT p.doc_id, count(x.i) AS n_removed, string_agg(word, ' ' ORDER BY p.i) FILTER (x.i IS NULL) AS kept FROM p LEFT JOIN x ON p.doc_id = x.doc_id AND p.i = x.i GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""


def _rounds(k: int, n: int) -> str:
    """Assignments a0 ... an of k0's vectors to ``k`` centroids c0 ... cn, each round's from the one before."""
    out = f"""k0 AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
  c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS c, x FROM k0 QUALIFY c < {k})"""
    for i in range(n + 1):
        out += f""",
  d{i} AS MATERIALIZED (SELECT vec_id, k0.x, c, CAST(list_sum(list_transform(list_zip(k0.x, c{i}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM k0, c{i}),
  a{i} AS MATERIALIZED (SELECT vec_id, x, c, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)"""
        if i < n:
            out += f""",
  s{i} AS MATERIALIZED (SELECT c, i, sum(e) AS s, CAST(count(*) AS HUGEINT) AS n FROM (SELECT c, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{i}) GROUP BY c, i),
  m{i} AS MATERIALIZED (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{i} GROUP BY c),
  c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} ON c{i}.c = m{i}.c)"""
    return out


OP12 = f"""
WITH {_rounds(16, 3)}
SELECT vec_id, CAST(a3.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a3.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c3.x, ',')) AS centroid_sha256 FROM a3 JOIN c3 ON a3.c = c3.c
"""

OP13 = """
WITH t AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, d, unnest(ps) AS p, generate_subscripts(ps, 1) AS j FROM (SELECT *, string_split_regex(t, '[.,;:!?\n-\r]') AS ps FROM t)),
s AS (SELECT lang, d, j, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM p),
w AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM s),
n AS (SELECT lang, count(*) AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, list_slice(ws, i, i + k - 1) AS ph FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(ws)),
f AS MATERIALIZED (SELECT lang, k, ph, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, ph, f AS a FROM f WHERE k > 1),
cut AS (SELECT c.lang, c.k, c.ph, a, j, l.f AS l, r.f AS r, CAST(2000000 * CAST(a AS HUGEINT) // (l.f + r.f) AS BIGINT) AS score FROM c, (SELECT unnest([1, 2, 3]) AS j) AS js
  JOIN f AS l ON l.lang = c.lang AND l.ph = list_slice(c.ph, 1, j) JOIN f AS r ON r.lang = c.lang AND r.ph = list_slice(c.ph, j + 1, c.k) WHERE j < c.k),
worst AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, j) = 1),
inside AS (SELECT c.lang, list_slice(ph, o, o + m - 1) AS ph, max(a) AS longer FROM c, (SELECT unnest([2, 2, 2, 3, 3]) AS m, unnest([1, 2, 3, 1, 2]) AS o) AS s WHERE m < k AND o + m - 1 <= k GROUP BY ALL),
z AS (SELECT worst.lang, array_to_string(worst.ph, ' ') AS phrase, a, l, r, score FROM worst LEFT JOIN inside AS i ON i.lang = worst.lang AND i.ph = worst.ph WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(a AS HUGEINT))
SELECT z.lang, row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM z JOIN n ON n.lang = z.lang QUALIFY rank <= 2000
"""

ORACLES = {
    "quality_ablations": ABLATIONS,
    "op1_line_dedup": OP1,
    "op4_quality_rules": OP4,
    "op10_substring_dedup": OP10,
    "op12_centroid_clustering": OP12,
    "op13_phrase_collocations": OP13,
}
