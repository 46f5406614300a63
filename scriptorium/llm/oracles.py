"""SQL of those operators that SQL can express, on whole tables."""

from __future__ import annotations

from . import quality_rules as rules
from . import secrets

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quality_rules() -> str:
    """Metrics by rows of words, sketches as counts of bins, thresholds of the smallest level with enough documents."""
    units = {r: f"({a} * {rules.UNIT}) // greatest({b}, 1)" for r, (a, b) in rules.PARTS.items()}
    shift = {r: f"greatest(length(bin({u})) - {rules.BIN_BITS}, 0)" for r, u in units.items()}
    bins = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS ratio, (({u}) >> ({shift[r]})) << ({shift[r]}) AS edge FROM sound" for r, u in units.items())

    def quantiles(name: str, keys: str) -> str:
        by = f"{keys}, " if keys else ""
        at = lambda r, p: f"min(edge) FILTER (ratio = '{r}' AND 100 * upto >= {p} * total) / {float(rules.UNIT)}::DOUBLE"
        found = ", ".join(f"{at(r, 25)} AS q25_{r}, {at(r, high)} AS high_{r}" for r, (high, _, _) in rules.RATIOS.items())
        return f"""{name}_n AS (SELECT {by}ratio, edge, sum(n)::BIGINT AS n FROM counts GROUP BY {by}ratio, edge),
{name}_w AS (SELECT *, sum(n) OVER (PARTITION BY {by}ratio ORDER BY edge ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY {by}ratio) AS total FROM {name}_n),
{name} AS (SELECT {by}max(total) AS n, {found} FROM {name}_w {"GROUP BY " + keys if keys else ""})"""

    limits = []
    for r, (_, share, floor) in rules.RATIOS.items():
        q25, high = (f"CASE WHEN g.n >= 200 THEN g.{q}_{r} WHEN l.n >= 200 THEN l.{q}_{r} ELSE a.{q}_{r} END" for q in ("q25", "high"))
        width = f"{float(6.0 * share)}::DOUBLE * greatest(({high}) - ({q25}), {floor}::DOUBLE)"
        limits.append(f"({high}) + {width} AS max_{r}")
        if r == "word_length":
            limits.append(f"({q25}) - {width} AS min_{r}")
    ratio = {r: f"{a}::DOUBLE / greatest({b}, 1)" for r, (a, b) in rules.PARTS.items()}
    fits = " AND ".join([*[f"{x} <= max_{r}" for r, x in ratio.items()], f"{ratio['word_length']} >= min_word_length"])
    return f"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
lists AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS x FROM texts),
words AS (SELECT rid, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM lists),
windows AS (SELECT rid, i, string_agg(w, ' ') OVER o AS s, count(*) OVER o AS c FROM words WINDOW o AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM windows WHERE c = 8),
covered AS (SELECT DISTINCT rid, unnest(range(i, i + 8)) AS i FROM twice WHERE c > 1),
repeats AS (SELECT rid, count(*) AS n FROM covered GROUP BY rid),
measured AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         len(x)::BIGINT AS n_lines, (len(x) - len(list_distinct(x)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM lists LEFT JOIN repeats r USING (rid)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured),
sound AS (SELECT * FROM judged WHERE NOT base_failed),
counts AS (SELECT lang, source, ratio, edge, count(*) AS n FROM ({bins}) GROUP BY lang, source, ratio, edge),
{quantiles("by_group", "lang, source")},
{quantiles("by_lang", "lang")},
{quantiles("whole", "")},
limits AS (SELECT g.lang, g.source, {", ".join(limits)} FROM by_group g JOIN by_lang l ON g.lang IS NOT DISTINCT FROM l.lang CROSS JOIN whole a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({fits}, true) AS kept
FROM judged j LEFT JOIN limits m ON j.lang IS NOT DISTINCT FROM m.lang AND j.source IS NOT DISTINCT FROM m.source
"""


def secret_scans() -> str:
    """Matches and what stands between them give positions; entropy is counted anew in each window."""
    assign = secrets.ASSIGN.replace("'", "''")
    patterns = {"assign": assign, "access": secrets.ACCESS, "hex": "[0-9a-f]{32,}", "entropy": f"[A-Za-z0-9+/_=-]{{{secrets.WINDOW},}}"}
    group = {"assign": 2}
    kinds = " UNION ALL ".join(
        f"SELECT rid, {n} AS no, '{k}' AS kind, unnest(regexp_extract_all(t, '{p}')) AS m, unnest(regexp_extract_all(t, '{p}', {group.get(k, 0)})) AS v, "
        f"unnest(string_split_regex(t, '{p}')) AS g, generate_subscripts(string_split_regex(t, '{p}'), 1) AS i FROM texts WHERE regexp_matches(t, '{p}')"
        for n, (k, p) in enumerate(patterns.items())
    )
    bits = " ".join(f"WHEN regexp_matches(m, '{p}') THEN {b}::DOUBLE" for p, b in secrets.CLASSES)
    allowed = " OR ".join(f"regexp_matches(m, '{p}')" for p in secrets.ALLOWED)
    size = secrets.WINDOW
    return f"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
matches AS ({kinds}),
placed AS (
  SELECT *, sum(length(g)) OVER o + coalesce(sum(length(m)) OVER (PARTITION BY rid, no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
  FROM matches WINDOW o AS (PARTITION BY rid, no ORDER BY i ROWS UNBOUNDED PRECEDING)),
base AS (SELECT rid, no, kind, s::BIGINT AS s, (s + length(m))::BIGINT AS e FROM placed WHERE m IS NOT NULL AND no < 3 AND (no > 0 OR length(v) >= {secrets.LEAST_ASSIGNED})),
runs AS (SELECT rid, no, kind, s::BIGINT AS s, (s + length(m))::BIGINT AS e, m, CASE {bits} END AS least FROM placed WHERE m IS NOT NULL AND no = 3 AND NOT ({allowed})),
fresh AS (SELECT * FROM runs r WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = r.rid AND b.s < r.e AND r.s < b.e)),
windows AS (SELECT rid, s, least, j, substr(m, j, {size}) AS w FROM (SELECT *, unnest(range(1, length(m) - {size} + 2)) AS j FROM fresh)),
chars AS (SELECT rid, s, j, c, count(*) AS n FROM (SELECT rid, s, j, unnest(string_split(w, '')) AS c FROM windows) GROUP BY ALL),
best AS (SELECT rid, s, max(bits) AS bits FROM (SELECT rid, s, j, log2({size}) - sum(n * log2(n)) / {size} AS bits FROM chars GROUP BY ALL) GROUP BY ALL),
spans AS (
  SELECT * FROM base UNION ALL
  SELECT f.rid, no, kind, f.s, e FROM fresh f JOIN best b ON f.rid = b.rid AND f.s = b.s WHERE bits >= least)
SELECT doc_id, count(s) FILTER (no = 0) AS n_assign, count(s) FILTER (no = 1) AS n_access, count(s) FILTER (no = 2) AS n_hex,
       sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no, e) FILTER (no < 3), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no, e), '') AS spans
FROM texts LEFT JOIN spans USING (rid) GROUP BY rid, doc_id
"""


SUFFIX_DEDUP = """
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS t FROM documents),
starts AS (SELECT rid, t, unnest(range(1, octet_length(t) - 398)) AS i FROM texts WHERE octet_length(t) >= 400),
digests AS (SELECT rid, i, md5_number(t[i:i + 399]) AS h FROM starts),
often AS (SELECT h FROM digests GROUP BY h HAVING count(*) > 1),
marked AS (SELECT rid, i FROM digests WHERE h IN (SELECT h FROM often)),
edges AS (SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM marked),
numbered AS (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM edges),
runs AS (SELECT rid, run, min(i) AS s, max(i) + 400 AS e FROM numbered GROUP BY rid, run),
ends AS (SELECT rid, 1 AS s, 1 AS e FROM texts UNION ALL SELECT rid, s, e FROM runs),
pieces AS (
  SELECT rid, t, s, e, coalesce(lead(s) OVER (PARTITION BY rid ORDER BY s, e), octet_length(t) + 1) AS following
  FROM ends JOIN texts USING (rid)),
kept AS (
  SELECT rid, sum(e - s)::BIGINT AS n_removed, count(*) - 1 AS n_spans, sha256(unhex(string_agg(CASE WHEN following > e THEN hex(t[e:following - 1]) ELSE '' END, '' ORDER BY s, e))) AS kept_sha256
  FROM pieces GROUP BY rid)
SELECT doc_id, octet_length(t)::BIGINT AS n_bytes, n_removed, n_spans, kept_sha256 FROM texts JOIN kept USING (rid)
"""

NEAR_DEDUP = f"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, len(w) AS n, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM texts),
windows AS (SELECT doc_id, n, i, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s FROM words),
shingles AS (SELECT DISTINCT doc_id, md5_number(s) AS s FROM windows WHERE i = 1 OR i <= n - 4),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * both_have >= 85 * (x.n + y.n - both_have)),
reached AS (SELECT doc_id, doc_id AS other FROM texts UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a),
classes AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT c.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept FROM classes c LEFT JOIN sizes s ON c.doc_id = s.doc_id
"""

ORACLES = {"op4_quality_rules": quality_rules(), "op8_secret_scans": secret_scans(), "op9_suffix_array_dedup": SUFFIX_DEDUP, "op10_minhash_near_dedup": NEAR_DEDUP}
