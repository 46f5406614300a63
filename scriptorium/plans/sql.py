"""The SQL that each registered query must equal, for DuckDB over the same tables."""

from __future__ import annotations


def terms(c: str) -> str:
    return (
        f"flatten(list_transform(regexp_extract_all({c}, '[\\x{{4e00}}-\\x{{9fff}}]+|[a-zA-Z0-9_]+'), lambda r: CASE WHEN regexp_full_match(r, '[a-zA-Z0-9_]+') THEN [lower(r)] "
        f"WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END))"
    )


TOKENS = f"SELECT doc_id, CAST(len({terms('text')}) AS INTEGER) AS n_terms, md5(array_to_string({terms('text')}, ' ')) AS digest FROM documents"

_WS = "[ \\t\\n\\r\\f\\x0b\\x{00a0}\\x{3000}]"
SQUEEZE = f"""SELECT doc_id, md5(lower(regexp_replace(text, '{_WS}+', '', 'g'))) AS squeezed,
  md5(regexp_replace(regexp_replace(replace(text, chr(13), ''), '[ \\t\\x{{00a0}}\\x{{3000}}]+', ' ', 'g'), '^{_WS}+|{_WS}+$', '', 'g')) AS collapsed FROM documents"""

CLEAN = f"""WITH l AS (SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_full_match(x, '\\s*(\\d{{1,4}}|第\\s*\\d+\\s*页|\\d+\\s*/\\s*\\d+)\\s*')), chr(10)) AS t FROM documents),
c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\\n[ \\t]*(\\n[ \\t]*)+\\n', chr(10) || chr(10), 'g'), '^{_WS}+|{_WS}+$', '', 'g') AS t FROM l)
SELECT doc_id, CAST(len(string_split(t, chr(10))) AS INTEGER) AS n_lines, CAST(length(t) AS INTEGER) AS n_chars FROM c"""

SENTENCES = f"""WITH p AS (SELECT doc_id, text, list_filter(list_transform(string_split(regexp_replace(text, '([。！？!?；;][”’"'')）」』]?|\\n)\\s*', '\\1' || chr(31), 'g'), chr(31)), lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x <> '') AS s FROM documents),
f AS (SELECT doc_id, CASE WHEN len(s) > 0 THEN s ELSE [text] END AS s FROM p)
SELECT doc_id, CAST(len(s) AS INTEGER) AS n_sentences, CAST(length(array_to_string(s, '')) AS INTEGER) AS n_chars FROM f"""

SLUGS = """WITH n AS (SELECT page_id, url, lower(string_split(url, '/')[-1]) AS f FROM pages), s AS (SELECT *, regexp_replace(f, '\\.[^.]*$', '') AS stem FROM n)
SELECT page_id, substr(regexp_replace(regexp_replace(lower(url), '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 40) AS slug,
  CASE WHEN stem = 'faq' THEN 'faq' WHEN ends_with(stem, '-example') THEN 'tutorial' WHEN contains(stem, 'log_info') THEN 'error' WHEN regexp_matches(stem, '^(group_|struct_|class_|functions_|dir_|namespace)') THEN 'api' ELSE 'guide' END AS content_type,
  coalesce(list_filter(string_split(url, '/'), lambda x: trim(x) <> '')[-1], '') AS last_part, regexp_replace(url, '[^\\p{L}\\p{N}._-]', '_', 'g') AS collection FROM s"""

IDENTIFIERS = """WITH t AS (SELECT item_id AS qid, text, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{4,}'), lambda x: lower(x))) AS ids FROM benchmark),
u AS (SELECT qid, text, unnest(ids) AS t FROM t), o AS (SELECT qid, t, row_number() OVER (PARTITION BY qid ORDER BY length(t) DESC, t) AS r FROM u
  WHERE t NOT IN ('about', 'after', 'their', 'there', 'these', 'those', 'which', 'while', 'would', 'should', 'could'))
SELECT b.item_id AS qid, coalesce((SELECT string_agg(t, ',' ORDER BY r) FROM o WHERE o.qid = b.item_id AND r <= 3), '') AS tokens, replace(substr(b.text, 1, 40), chr(10), '⏎') AS preview FROM benchmark b"""

_LINES = "lines AS (SELECT doc_id AS doc, text AS whole, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS page FROM documents)"
PRINTED = f"""WITH {_LINES}, s AS (SELECT doc, page, CASE WHEN regexp_full_match(trim(text), '\\d{{1,4}}') THEN CAST(trim(text) AS INTEGER) END AS seen, CASE WHEN page - 6 >= 1 THEN page - 6 END AS rule FROM lines)
SELECT doc, count(*) AS n_pages, count(coalesce(seen, rule)) AS n_printed, count(*) FILTER (seen <> rule) AS n_anomalies FROM s GROUP BY doc"""

_STATS = f"""toks AS (SELECT doc_id AS node_id, lang, {terms('text')} AS tokens FROM documents WHERE regexp_replace(text, '{_WS}+', '', 'g') <> ''),
dl AS (SELECT node_id, lang, len(tokens) AS dl FROM toks), cs AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
post AS (SELECT node_id, term, count(*) AS tf FROM (SELECT node_id, unnest(tokens) AS term FROM toks) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({terms('text')}) AS term FROM benchmark) GROUP BY 1, 2)"""


def _hits(name: str, k: int, k1: float = 1.5, b: float = 0.75, where: str = "true") -> str:
    """CTEs <name>_s (scores) and <name> (hits)."""
    return f"""{name}_s AS (SELECT qid, node_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))) AS score
  FROM q JOIN df USING (term) JOIN post USING (term) JOIN dl USING (node_id) CROSS JOIN cs WHERE {where} GROUP BY 1, 2),
{name} AS (SELECT * FROM (SELECT qid, node_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, node_id) AS INTEGER) AS rank FROM {name}_s WHERE score > 0) WHERE rank <= {k})"""


def bm25_topk(where: str = "true") -> str:
    return f"WITH {_STATS}, {_hits('h', 5, where=where)} SELECT qid, node_id, rank, round(score, 6) AS score FROM h"


DF = f"WITH {_STATS} SELECT term, df FROM df"
CORPUS = f"WITH {_STATS} SELECT n, round(avgdl, 4) AS avgdl FROM cs"
NO_EVIDENCE = "SELECT item_id AS qid FROM benchmark"


def vector_topk(where: str = "true") -> str:
    return f"""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM e),
s AS (SELECT a.vec_id AS qid, b.vec_id AS node_id, round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 4) AS score FROM u a JOIN u b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND {where.replace('label', 'b.label')})
SELECT * FROM (SELECT qid, node_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, node_id) AS INTEGER) AS rank, score FROM s) WHERE rank <= 5"""


VECTOR_METRICS = f"WITH h AS ({vector_topk()}) SELECT h.qid AS qid, round(avg(CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END), 4) AS precision FROM h JOIN embeddings a ON a.vec_id = h.node_id JOIN embeddings b ON b.vec_id = h.qid GROUP BY h.qid"

_TWO = f"{_STATS}, {_hits('a', 30)}, {_hits('b', 30, 0.9, 0.4)}"
_FIVE = f"{_STATS}, {_hits('a', 5)}, {_hits('b', 5, 0.9, 0.4)}"
RRF = f"""WITH {_TWO}, f AS (SELECT qid, node_id, sum(1.0 / (60 + rank)) AS s FROM (SELECT qid, node_id, rank FROM a UNION ALL SELECT qid, node_id, rank FROM b) GROUP BY 1, 2)
SELECT * FROM (SELECT qid, node_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(s, 12) DESC, node_id) AS INTEGER) AS rank, round(s, 6) AS score FROM f) WHERE rank <= 5"""

BOOST = f"""WITH {_STATS}, {_hits('h', 30)}, p AS (SELECT qid, node_id, round(score, 6) AS score FROM h), m AS (SELECT *, min(score) OVER (PARTITION BY qid) AS lo, max(score) OVER (PARTITION BY qid) AS hi FROM p),
b AS (SELECT qid, node_id, round(CASE WHEN hi = lo THEN 0.5 ELSE (score - lo) / (hi - lo) END + CASE WHEN lang = 'en' THEN 0.1 ELSE 0.0 END, 4) AS score FROM m JOIN documents ON doc_id = node_id)
SELECT * FROM (SELECT qid, node_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, node_id) AS INTEGER) AS rank, score FROM b) WHERE rank <= 5"""

RERANK = f"""WITH {_STATS}, {_hits('h', 30)}, n AS (SELECT qid, count(*) AS n FROM q GROUP BY 1),
c AS (SELECT h.qid AS qid, h.node_id AS node_id, round(count(post.term) / any_value(n.n), 6) AS score FROM h JOIN n ON n.qid = h.qid JOIN q ON q.qid = h.qid LEFT JOIN post ON post.node_id = h.node_id AND post.term = q.term GROUP BY 1, 2)
SELECT * FROM (SELECT qid, node_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, node_id) AS INTEGER) AS rank, score FROM c) WHERE rank <= 5"""

CONTEXT = f"""WITH {_STATS}, {_hits('h', 3)}, c AS (SELECT qid, string_agg('[' || rank || '] 来源：HTML ' || source || ' ' || d.lang || ' / ' || source || chr(10) || regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g'), chr(10) || chr(10) ORDER BY rank) AS context FROM h JOIN documents d ON doc_id = node_id GROUP BY qid)
SELECT qid, md5(context) AS digest, CAST(length('请只根据资料回答问题，用 [n] 标注来源；不同版本有差异时请分别说明；资料不足时请直接说明。' || chr(10) || chr(10) || '资料：' || chr(10) || context || chr(10) || chr(10) || '问题：?') AS INTEGER) AS n_prompt FROM c"""

REFS = f"WITH {_STATS}, {_hits('h', 3)} SELECT qid, rank, node_id, source AS source_id, source AS source_name, d.lang || ' / ' || source AS section, CAST(NULL AS INTEGER) AS page_print FROM h JOIN documents d ON doc_id = node_id"
MOCK = """WITH s AS (SELECT item_id AS qid, CAST('0x' || substr(md5(text), 1, 8) AS BIGINT) AS seed, unnest([0, 1, 2]) AS i FROM benchmark)
SELECT qid, 'mock_' || lpad(CAST((seed + i) % 10000 AS VARCHAR), 4, '0') AS node_id, CAST(i + 1 AS INTEGER) AS rank, round(1.0 - i * 0.05, 4) AS score FROM s"""

_TRUTH = "truth AS (SELECT item_id AS qid, doc_id AS node_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_PER = f"""{_STATS}, {_hits('h', 5)}, {_TRUTH}, j AS (SELECT h.qid, h.rank, t.node_id IS NOT NULL AS rel FROM h LEFT JOIN truth t ON t.qid = h.qid AND t.node_id = h.node_id),
g AS (SELECT qid, count(*) AS n, count(*) FILTER (rel) AS found, min(rank) FILTER (rel) AS first FROM j GROUP BY 1), e AS (SELECT qid, count(*) AS expected FROM truth GROUP BY 1),
m AS (SELECT e.qid AS qid, CASE WHEN coalesce(found, 0) > 0 THEN 1.0 ELSE 0.0 END AS hit_rate, coalesce(1.0 / first, 0.0) AS mrr, coalesce(found / n, 0.0) AS precision, coalesce(found, 0) / expected AS recall FROM e LEFT JOIN g ON g.qid = e.qid)"""
METRICS = f"WITH {_PER} SELECT qid, CAST(hit_rate AS DOUBLE) AS hit_rate, round(CAST(mrr AS DOUBLE), 4) AS mrr, round(CAST(precision AS DOUBLE), 4) AS precision, round(CAST(recall AS DOUBLE), 4) AS recall FROM m"
SUMMARY = f"WITH {_PER} SELECT count(*) AS n_questions, round(avg(hit_rate), 4) AS hit_rate, round(avg(mrr), 4) AS mrr, round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall FROM m"
SKIPPED = f"WITH {_TRUTH} SELECT item_id AS qid FROM benchmark WHERE item_id NOT IN (SELECT qid FROM truth)"

_OVER = f"""{_FIVE}, la AS (SELECT qid, list(node_id ORDER BY rank) AS ids FROM a GROUP BY 1), lb AS (SELECT qid, list(node_id ORDER BY rank) AS ids FROM b GROUP BY 1),
o AS (SELECT item_id AS qid, coalesce(la.ids, []) AS x, coalesce(lb.ids, []) AS y FROM benchmark LEFT JOIN la ON la.qid = item_id LEFT JOIN lb ON lb.qid = item_id),
r AS (SELECT qid, x, y, CASE WHEN greatest(len(x), len(y)) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) / greatest(len(x), len(y)) END AS overlap, coalesce(x[1] = y[1], false) AS same_first FROM o)"""
OVERLAP = f"WITH {_OVER} SELECT qid, round(CAST(overlap AS DOUBLE), 4) AS overlap, same_first FROM r"
DELTA = f"WITH {_OVER} SELECT round(avg(overlap), 4) AS mean_overlap, round(avg(CASE WHEN same_first THEN 1.0 ELSE 0.0 END), 4) AS first_agreement, count(*) FILTER (len(x) = 0) AS n_empty_before, count(*) FILTER (len(y) = 0) AS n_empty_now FROM r"
AGREEMENT = f"WITH {_FIVE} SELECT 'a' AS mode_a, 'b' AS mode_b, count(*) AS n, round(avg(CASE WHEN a.node_id = b.node_id THEN 1.0 ELSE 0.0 END), 4) AS agreement FROM a JOIN b ON a.qid = b.qid AND a.rank = 1 AND b.rank = 1"
ERRORS = f"""WITH {_STATS}, {_hits('a', 1)}, {_hits('b', 1, 0.9, 0.4)}, {_TRUTH}, f AS (SELECT qid, node_id AS p FROM a UNION ALL SELECT qid, node_id FROM b)
SELECT DISTINCT qid, 'no_evidence' AS category FROM truth WHERE qid NOT IN (SELECT qid FROM f) UNION ALL
SELECT DISTINCT f.qid, 'wrong_first' FROM f WHERE f.qid IN (SELECT qid FROM truth) AND NOT EXISTS (SELECT 1 FROM truth t WHERE t.qid = f.qid AND f.p BETWEEN t.node_id - 1 AND t.node_id + 2) UNION ALL
SELECT qid, 'disagreement' FROM f GROUP BY qid HAVING count(DISTINCT p) > 1"""

VERDICTS = """WITH r AS (SELECT lang AS run_id, count(*) AS n FROM documents GROUP BY 1),
c AS (SELECT run_id, n, n % 4 = 1 AS no_before, true AS now_sha, n % 3 <> 2 AS before_sha, CAST(n % 50 AS DOUBLE) AS s, n % 10 / 10.0 AS overlap FROM r),
x AS (SELECT *, CASE WHEN no_before THEN 'config_hash8,index_dirname,mode,top_k,questions_sha12,expected_sha12,nodes_sha12' WHEN NOT before_sha THEN 'nodes_sha12' ELSE '' END AS reasons FROM c)
SELECT run_id, reasons, CASE WHEN no_before THEN 'no_baseline' WHEN reasons <> '' THEN 'incomparable' WHEN overlap < 0.8 THEN 'regression' ELSE 'pass' END AS verdict FROM x"""

HASHES = """SELECT r_regionkey, substr(sha256('{"r_name":"' || r_name || '","r_regionkey":' || r_regionkey || '}'), 1, 8) AS hash8 FROM region"""
FINGERPRINTS = "SELECT doc_id, substr(sha256(replace(text, chr(13) || chr(10), chr(10))), 1, 12) AS sha12 FROM documents"
SAMPLE = "SELECT item_id AS qid, replace(substr(text, 1, 60), chr(10), '⏎') AS preview FROM benchmark ORDER BY md5(CAST(item_id AS VARCHAR)), item_id LIMIT 30"

COUNTERS = f"""WITH d AS (SELECT text AS t, length(regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g')) AS n, len({terms('text')}) AS tokens, (len(string_split(text, '```')) - 1) % 2 AS f, len(list_filter(string_split(text, chr(10)), lambda x: regexp_full_match(x, '\\s*\\d{{1,4}}\\s*'))) AS pn FROM documents)
SELECT count(*) AS total, count(*) FILTER (n = 0) AS empty, count(*) FILTER (n > 0 AND n < 20) AS short, count(*) FILTER (n > 10000) AS long, count(*) FILTER (tokens > 1200) AS over_tokens, count(t) - count(DISTINCT t) AS duplicates, CAST(sum(pn) AS BIGINT) AS page_number_lines, count(*) FILTER (f = 1) AS broken_code FROM d"""
LENGTHS = "SELECT CAST(min(length(text)) AS INTEGER) AS min, CAST(max(length(text)) AS INTEGER) AS max, CAST(floor(avg(length(text))) AS BIGINT) AS mean, CAST(floor(quantile_cont(length(text), 0.5)) AS BIGINT) AS p50, CAST(floor(quantile_cont(length(text), 0.95)) AS BIGINT) AS p95 FROM documents"
NEAREST_RANK = "WITH o AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT lang, n_chars AS value FROM o WHERE i = round_even(0.95 * (n - 1), 0)"
DUPLICATES = "SELECT md5(text) AS digest, count(*) - 1 AS extra FROM documents GROUP BY text HAVING count(*) > 1"
INSPECT = "SELECT lang AS version, count(*) AS n, count(*) - count(DISTINCT doc_id) AS repeated_ids, count(*) - count(DISTINCT text) AS repeated_texts, CAST(min(length(text)) AS INTEGER) AS shortest, CAST(max(length(text)) AS INTEGER) AS longest FROM documents GROUP BY lang"

_PROBLEMS = """p AS (SELECT doc_id, text, list_filter([CASE WHEN doc_id % 3 = 2 THEN 'source_type' END, CASE WHEN doc_id % 10 = 0 THEN 'source_file' END, CASE WHEN doc_id % 3 <> 1 THEN 'chapter' END,
  CASE WHEN doc_id % 3 = 1 THEN 'source_url' END, CASE WHEN doc_id % 4 = 0 THEN 'content_type' END], lambda x: x IS NOT NULL) AS p FROM documents)"""
METADATA = f"WITH {_PROBLEMS} SELECT CAST(doc_id AS VARCHAR) AS chunk_id, array_to_string(p, ',') AS problems FROM p"
CONTRACT = f"""WITH {_PROBLEMS}, f AS (SELECT source, arg_min(doc_id % 5 - 7, doc_id) AS d0 FROM documents GROUP BY 1)
SELECT 'metadata:' || x AS rule, count(*) AS n FROM (SELECT unnest(p) AS x FROM p) GROUP BY 1 UNION ALL
SELECT 'page_delta', count(*) FROM documents JOIN f USING (source) WHERE doc_id % 5 - 7 <> d0 HAVING count(*) > 0"""
GAPS = "WITH o AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 7 <> 0) SELECT k AS o_orderkey FROM (SELECT unnest(range((SELECT min(k) FROM o), (SELECT max(k) FROM o) + 1)) AS k) WHERE k NOT IN (SELECT k FROM o)"
DELTAS = f"WITH {_LINES} SELECT doc, count(*) AS n FROM lines WHERE page % 11 = 0 GROUP BY doc"
CATEGORIES = "SELECT r_name AS category, count(n_name) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1"

TITLES = "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS INTEGER) AS n_links FROM pages"
FILES = """SELECT page_id, string_split(url, '/')[-1] AS file_name FROM pages WHERE NOT list_has_any(string_split(url, '/'), ['search', 'static']) AND NOT ends_with(string_split(url, '/')[-1], '_source.html')
  AND NOT regexp_matches(string_split(url, '/')[-1], '^(annotated|classes|functions|functions_.*|pages|modules|dir_.*|files|globals.*|namespace.*)\\.html$')"""

_STRIP = f"regexp_replace(substr(text, 1, 40), '^{_WS}+|{_WS}+$', '', 'g')"
_TREE = f"{_LINES}, b AS (SELECT doc, page AS ord, CAST(page % 5 + 1 AS INTEGER) AS level, {_STRIP} AS title FROM lines)"
TREE = f"""WITH {_TREE}
SELECT doc, CAST(ord AS INTEGER) AS ord, level, CAST((SELECT max(p.ord) FROM b p WHERE p.doc = b.doc AND p.ord < b.ord AND p.level < b.level) AS INTEGER) AS parent,
  coalesce((SELECT arg_max(p.title, p.ord) FROM b p WHERE p.doc = b.doc AND p.ord <= b.ord AND p.level = 1), '') AS part,
  coalesce((SELECT arg_max(p.title, p.ord) FROM b p WHERE p.doc = b.doc AND p.ord <= b.ord AND p.level = 2 AND b.level >= 2 AND p.ord > coalesce((SELECT max(o.ord) FROM b o WHERE o.doc = b.doc AND o.ord <= b.ord AND o.level = 1), -1)), '') AS chapter FROM b"""
_RANGES = f"""{_TREE}, t AS (SELECT doc, max(page) AS total FROM lines GROUP BY doc),
r AS (SELECT b.doc AS doc, b.ord AS ord, b.level AS level, CAST(b.ord AS INTEGER) AS page_start, CAST(coalesce((SELECT min(n.ord) FROM b n WHERE n.doc = b.doc AND n.ord > b.ord AND n.level <= b.level), t.total) AS INTEGER) AS page_end FROM b JOIN t ON t.doc = b.doc)"""
RANGES = f"WITH {_RANGES} SELECT doc, CAST(ord AS INTEGER) AS ord, page_start, page_end, page_end - 6 AS printed_end FROM r"
COVER = f"""WITH {_RANGES}, c AS (SELECT l.doc AS doc, l.page AS page, r.ord AS ord, row_number() OVER (PARTITION BY l.doc, l.page ORDER BY r.level DESC, r.ord) AS n FROM lines l JOIN r ON r.doc = l.doc AND l.page BETWEEN r.page_start AND r.page_end)
SELECT doc, CAST(page AS INTEGER) AS physical_page, CAST(ord AS INTEGER) AS ord FROM c WHERE n = 1"""
STRIDES = "WITH s AS (SELECT doc_id, text, unnest(range(1, greatest(length(text), 1) + 1, 450)) AS i FROM documents) SELECT doc_id, CAST((i - 1) // 450 AS INTEGER) AS piece, md5(substr(text, i, 500)) AS digest FROM s"
FILL = "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events"
JACCARD = """WITH c AS (SELECT item_id AS qid, list_distinct(string_split(regexp_replace(text, '\\s+', '', 'g'), '')) AS x FROM benchmark), p AS (SELECT DISTINCT p_type, list_distinct(string_split(regexp_replace(p_type, '\\s+', '', 'g'), '')) AS y FROM part)
SELECT qid, max(round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6)) AS best FROM c CROSS JOIN p GROUP BY qid"""

MISSING = "SELECT doc_id AS question_id, 'CONTRACT_MISSING' AS code FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"
BOUNDS = "SELECT source AS source_id, CAST(min(doc_id % 7 + 1) AS INTEGER) AS lo, CAST(max(doc_id % 7 + 2) AS INTEGER) AS hi FROM documents GROUP BY 1"
WIDE = "SELECT doc_id AS question_id, doc_id % 9 BETWEEN quality + 1 - 2 AND quality + 3 + 2 AS near, false AS wide FROM labels JOIN documents USING (doc_id)"

JUDGES = """WITH s AS (SELECT conv_id, turn, conv_id % 8 AS n, turn % 3 <> 2 AS ok FROM conversations)
SELECT conv_id, turn, CASE WHEN ok THEN round(least(n, 5) / 5.0, 4) ELSE 0.0 END AS score, CAST(CASE WHEN ok THEN least(n, 5) ELSE 0 END AS INTEGER) AS raw_score, ok AS parse_ok FROM s"""
ABSTAIN = "SELECT conv_id, count(*) FILTER (conv_id % 5 = 0) AS n_abstained, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY conv_id"
LAST_RECORD = "SELECT conv_id AS request_id, md5(arg_max(text, turn)) AS digest FROM conversations GROUP BY conv_id"
SLICES = "SELECT conv_id || '-' || turn AS request_id, greatest((length(text) + 23) // 24, 1) AS n, length(text) AS n_chars FROM conversations WHERE role = 'assistant'"
WINDOWS = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"
CHECKLIST = "SELECT doc_id, source, CAST(n AS INTEGER) AS n FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 20"

BREACHES = f"WITH {_STATS}, {_hits('h', 5)} SELECT qid, count(*) AS n FROM h JOIN documents ON doc_id = node_id WHERE documents.lang <> 'en' GROUP BY qid"
CORRECTED = "SELECT doc_id, CASE WHEN doc_id % 14 = 0 THEN 'xx' ELSE lang END AS lang, source FROM documents"
SCOPES = """WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)
SELECT page_id, CASE WHEN starts_with(path, 'www.') THEN 'all' WHEN starts_with(path, 'm.') OR starts_with(path, 'blog.') THEN 'selected' ELSE 'none' END AS scope FROM p"""
HISTOGRAM = "SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 4) AS share FROM events GROUP BY 1"
GREP = "SELECT doc_id AS node_id, replace(substr(text, 1, 120), chr(10), '⏎') AS preview FROM documents WHERE contains(text, 'token') ORDER BY doc_id LIMIT 20"
SUITE = "SELECT count(*) AS n, count(*) AS n_abstained, true AS passed FROM conversations"
ANSWERS = "SELECT 'faithfulness' AS metric, round(avg(CASE WHEN item_id % 3 <> 0 THEN least(length(text) % 6, 5) / 5.0 ELSE 0.0 END), 4) AS mean, count(*) AS n, count(*) FILTER (item_id % 3 = 0) AS n_abstained FROM benchmark"

HYBRID = f"""WITH {_STATS}, {_hits('a', 30)}, e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
u AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda y: y * y))) AS n FROM e),
s AS (SELECT x.vec_id AS qid, y.vec_id AS node_id, round(list_sum(list_transform(list_zip(x.v, y.v), lambda z: z[1] * z[2])) / (x.n * y.n), 4) AS score FROM u x JOIN u y ON x.vec_id IN (SELECT item_id FROM benchmark)),
w AS (SELECT * FROM (SELECT qid, node_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, node_id) AS rank FROM s) WHERE rank <= 30),
f AS (SELECT qid, node_id, sum(1.0 / (60 + rank)) AS s FROM (SELECT qid, node_id, rank FROM a UNION ALL SELECT qid, node_id, rank FROM w) GROUP BY 1, 2)
SELECT * FROM (SELECT qid, node_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(s, 12) DESC, node_id) AS INTEGER) AS rank, round(s, 6) AS score FROM f) WHERE rank <= 5"""

REQUESTS = """SELECT conv_id, turn, coalesce(text, '') = '' OR regexp_full_match(text, '\\s*') OR length(text) > 2000 AS bad_question, turn < 1 OR turn > 20 AS bad_top_k, NOT regexp_full_match(role, '[A-Za-z0-9_-]{1,64}') AS bad_experiment FROM conversations"""
RECORDS = """SELECT item_id AS qid, 'mock' AS mode, 3 AS top_k, CASE WHEN item_id % 3 <> 0 THEN 3 ELSE 0 END AS result_count FROM benchmark"""
STATISTICS = """SELECT count(*) AS documents, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS documents_with_nodes, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS documents_without_nodes,
  (SELECT count(*) FROM documents WHERE length(text) < 100) AS skipped, (SELECT count(*) FROM pages) AS nodes, (SELECT count(*) FROM labels) AS chunks FROM documents"""
EVIDENCE = "SELECT item_id AS node_id FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM labels)"
