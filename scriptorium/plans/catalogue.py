"""QUERIES and ORACLES: one entry per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import numeric, text as tx
from ..operators import audit, chunkers, evaluation as ev, html, lifecycle as lc, maintenance as mt, retrieval as rt, sections, validation as va
from ..sources import readers, writers
from ..sources.sized import sized_broadcast
from ..sources.stored import settle_by
from ..streaming import logs
from . import sql, tables as tb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# --- text functions ---------------------------------------------------------------------------


@query(sql.TOKENS)
def tokenize_terms(spark, d):
    t = tx.terms(F.col("text"))
    return tb.read(spark, d, "documents").select("doc_id", F.size(t).alias("n_terms"), F.md5(F.array_join(t, " ")).alias("digest"))


@query(sql.SQUEEZE)
def normalize_text(spark, d):
    return tb.read(spark, d, "documents").select("doc_id", F.md5(tx.squeeze(F.col("text"))).alias("squeezed"), F.md5(tx.collapse_blanks(F.col("text"))).alias("collapsed"))


@query(sql.CLEAN)
def clean_lines(spark, d):
    own = tb.read(spark, d, "documents").select("doc_id", tx.clean_page(F.col("text")).alias("t"))
    return own.select("doc_id", F.size(F.split("t", "\n", -1)).alias("n_lines"), F.length("t").alias("n_chars"))


@query(sql.SENTENCES)
def sentence_split(spark, d):
    s = tx.sentences(F.col("text"))
    return tb.read(spark, d, "documents").select("doc_id", F.size(s).alias("n_sentences"), F.length(F.array_join(s, "")).alias("n_chars"))


@query(sql.SLUGS)
def slugs_and_names(spark, d):
    p = tb.read(spark, d, "pages")
    name = F.element_at(F.split("url", "/"), -1)
    return p.select("page_id", tx.slug(F.col("url")).alias("slug"), tx.content_type(name).alias("content_type"), F.coalesce(tx.last_segment(F.col("url")), F.lit("")).alias("last_part"), tx.collection_name(F.col("url")).alias("collection"))


@query(sql.IDENTIFIERS)
def question_identifiers(spark, d):
    return tb.questions(spark, d).select("qid", F.array_join(tx.identifiers(F.col("question")), ",").alias("tokens"), tx.preview(F.col("question"), 40).alias("preview"))


@query(sql.PRINTED)
def printed_page_scan(spark, d):
    pages = readers.printed_pages(tb.lines(spark, d).select("doc", "physical_page", "text"))
    return pages.groupBy("doc").agg(F.count("*").alias("n_pages"), F.count("printed_page").alias("n_printed"), F.count_if("anomaly").alias("n_anomalies"))


# --- indexes and retrieval --------------------------------------------------------------------


def _index(spark, d, **options) -> rt.Bm25Index:
    return rt.build_bm25(tb.nodes(spark, d), **options)


@query(sql.DF)
def doc_frequency(spark, d):
    return _index(spark, d).term_stats


@query(sql.CORPUS)
def corpus_stats(spark, d):
    return _index(spark, d).corpus_stats.select("n", F.round("avgdl", 4).alias("avgdl"))


def _bm25(spark, d, k=5, **options):
    return rt.bm25_search(_index(spark, d, **options), tb.questions(spark, d), k)


def _two(spark, d, k):
    """Runs with the usual and the other parameters, of one reading of the texts."""
    return rt.bm25_runs(_index(spark, d), tb.questions(spark, d), k, [(rt.K1, rt.B), (LEXICAL_B["k1"], LEXICAL_B["b"])])


def _rounded(hits, digits=6):
    return hits.select("qid", "node_id", "rank", F.round("score", digits).alias("score"))


@query(sql.bm25_topk())
def bm25_topk(spark, d):
    return _rounded(_bm25(spark, d))


@query(sql.bm25_topk(where="lang = 'fr'"))
def bm25_filtered_topk(spark, d):
    nodes = tb.nodes(spark, d)
    return _rounded(rt.bm25_search(_index(spark, d), tb.questions(spark, d), 5, nodes.filter(rt.equals({"version": "fr"}))))


@query(sql.NO_EVIDENCE)
def bm25_no_evidence(spark, d):
    """Questions of words that no document has get no hits."""
    q = tb.questions(spark, d).withColumn("question", F.concat_ws(" ", *[F.concat(F.lit("zzq"), F.md5(F.col("qid").cast("string")))]))
    asked = q.union(tb.questions(spark, d))
    found = rt.bm25_search(_index(spark, d), q.withColumn("qid", F.col("qid") + 1_000_000), 5)
    return asked.select("qid").distinct().join(found.select((F.col("qid") - 1_000_000).alias("qid")), "qid", "left_anti")


@query(sql.vector_topk())
def vector_topk(spark, d):
    return rt.vector_search(tb.vectors(spark, d), tb.vector_questions(spark, d), 5, exclude_self=True)


@query(sql.vector_topk("label = 3"))
def vector_filtered_topk(spark, d):
    return rt.vector_search(tb.vectors(spark, d), tb.vector_questions(spark, d), 5, where=F.col("label") == 3, exclude_self=True)


@query(sql.VECTOR_METRICS)
def vector_label_precision(spark, d):
    """Share of hits with the question's own label."""
    hits = rt.vector_search(tb.vectors(spark, d), tb.vector_questions(spark, d), 5, exclude_self=True)
    labels = tb.vectors(spark, d).select("node_id", "label")
    rows = hits.join(labels, "node_id").join(labels.select(F.col("node_id").alias("qid"), F.col("label").alias("asked")), "qid")
    return rows.groupBy("qid").agg(F.round(F.avg((F.col("label") == F.col("asked")).cast("double")), 4).alias("precision"))


LEXICAL_B = {"k1": 0.9, "b": 0.4}


@query(sql.RRF)
def rrf_fusion(spark, d):
    return rt.fuse(_two(spark, d, 30), 5)


@query(sql.BOOST)
def version_boost(spark, d):
    pool = _rounded(_bm25(spark, d, 30))
    hits = rt.boost(tb.nodes(spark, d).select("node_id", "version").join(sized_broadcast(pool), "node_id"), F.col("version") == "en", 0.1, 4)
    return hits.filter("rank <= 5").select("qid", "node_id", "rank", "score")


@query(sql.RERANK)
def rerank_lexical(spark, d):
    return rt.rerank(_bm25(spark, d, 30), tb.nodes(spark, d), tb.questions(spark, d), rt.lexical_coverage, 5)


@query(sql.CONTEXT)
def answer_context(spark, d):
    hits = _bm25(spark, d, 3)
    c = rt.answer_context(hits, tb.nodes(spark, d).withColumn("page_print", F.lit(None).cast("int")))
    return c.select("qid", F.md5("context").alias("digest"), F.length(rt.prompt(F.col("context"), F.lit("?"))).alias("n_prompt"))


@query(sql.REFS)
def source_references(spark, d):
    return rt.source_refs(_bm25(spark, d, 3), tb.nodes(spark, d)).select("qid", "rank", "node_id", "source_id", "source_name", "section", "page_print")


@query(sql.MOCK)
def mock_retrieval(spark, d):
    return rt.mock_hits(tb.questions(spark, d), 3).select("qid", "node_id", "rank", F.round("score", 4).alias("score"))


# --- evaluation -------------------------------------------------------------------------------


@query(sql.METRICS)
def question_metrics(spark, d):
    m = ev.question_metrics(_bm25(spark, d), tb.truth(spark, d), 5)
    return m.select("qid", *[F.round(x, 4).alias(x) for x in ev.METRICS])


@query(sql.SUMMARY)
def bm25_topk_metrics(spark, d):
    return ev.aggregate_metrics(ev.question_metrics(_bm25(spark, d), tb.truth(spark, d), 5))


@query(sql.SKIPPED)
def skipped_questions(spark, d):
    return ev.skipped(tb.questions(spark, d), tb.truth(spark, d))


@query(sql.OVERLAP)
def topk_overlap(spark, d):
    rows = ev.run_overlap(*_two(spark, d, 5), tb.questions(spark, d), 5)
    return rows.select("qid", F.round("overlap", 4).alias("overlap"), "same_first")


@query(sql.DELTA)
def run_delta(spark, d):
    return ev.run_delta(ev.run_overlap(*_two(spark, d, 5), tb.questions(spark, d), 5))


@query(sql.AGREEMENT)
def mode_agreement(spark, d):
    return ev.mode_agreement(dict(zip("ab", _two(spark, d, 5), strict=True)))


@query(sql.VERDICTS)
def regression_verdict(spark, d):
    """Runs before and now, one per language, made of counts that differ."""
    runs = tb.read(spark, d, "documents").groupBy(F.col("lang").alias("run_id")).agg(F.count("*").alias("n"))
    run = lambda shift: F.struct(F.lit("h").alias("config_hash8"), F.lit("i").alias("index_dirname"), F.lit("bm25").alias("mode"), F.lit(5).alias("top_k"), F.lit("q").alias("questions_sha12"), F.lit("e").alias("expected_sha12"), F.when(F.col("n") % 3 != shift, F.lit("s")).alias("nodes_sha12"), (F.col("n") % 50).cast("double").alias("duration_seconds"))
    pairs = runs.select("run_id", run(5).alias("c"), F.when(F.col("n") % 4 != 1, run(2)).alias("p"), (F.col("n") % 10 / 10.0).alias("overlap"), F.lit(0).alias("n_empty_before"), F.lit(0).alias("n_empty_now"), F.lit(0.0).alias("drop"))
    return ev.compare_runs(pairs).select("run_id", F.array_join("reasons", ",").alias("reasons"), "verdict")


@query(sql.ERRORS)
def error_mining(spark, d):
    """First hits as pages against intervals of expected ids."""
    runs = {m: h.select("qid", "rank", F.col("node_id").cast("int").alias("page_print")) for m, h in zip("ab", _two(spark, d, 1), strict=True)}
    expected = tb.truth(spark, d).select("qid", F.col("node_id").cast("int").alias("page_lo"), (F.col("node_id") + 1).cast("int").alias("page_hi"))
    return ev.mine_errors(runs, expected)


@query(sql.HASHES)
def config_hash8(spark, d):
    t = tb.read(spark, d, "region")
    return t.select("r_regionkey", ev.config_hash("r_name", "r_regionkey").alias("hash8"))


@query(sql.FINGERPRINTS)
def fingerprint_sha12(spark, d):
    return tb.read(spark, d, "documents").select("doc_id", numeric.fingerprint(F.col("text")).alias("sha12"))


@query(sql.SAMPLE)
def manual_sample(spark, d):
    """Thirty questions for people to look at, those with the smallest digests."""
    q = tb.questions(spark, d)
    return q.orderBy(F.md5(F.col("qid").cast("string")), "qid").limit(30).select("qid", tx.preview(F.col("question"), 60).alias("preview"))


# --- quality and validation -------------------------------------------------------------------


@query(sql.COUNTERS)
def quality_counters(spark, d):
    return va.quality_counters(tb.read(spark, d, "documents"))


@query(sql.LENGTHS)
def length_percentiles(spark, d):
    return va.length_distribution(tb.read(spark, d, "documents"), F.length("text"))


@query(sql.NEAREST_RANK)
def inspector_percentile(spark, d):
    return va.rank_percentile(tb.read(spark, d, "documents"), "n_chars", "lang", 0.95)


@query(sql.DUPLICATES)
def exact_duplicates(spark, d):
    rows = va.repeated_rows(tb.read(spark, d, "documents"), "text")
    return rows.select(F.md5("text").alias("digest"), "extra")


@query(sql.INSPECT)
def node_inspection(spark, d):
    return va.inspect(tb.nodes(spark, d), "version")


def _described(spark, d):
    doc = tb.read(spark, d, "documents")
    meta = va.chunk_metadata(
        source_id=F.col("source"), source_file=F.when(F.col("doc_id") % 10 != 0, F.col("source")), source_type=F.when(F.col("doc_id") % 3 == 0, "pdf").when(F.col("doc_id") % 3 == 1, "html").otherwise("doc"),
        part=F.lit("p"), chapter=F.lit(""), section_path=F.concat(F.lit("a/"), "lang"), section_level=F.lit(3), node_ids=F.array("lang"), chunk_id=F.col("doc_id").cast("string"), product=F.lit("x"),
        printed_page_start=F.col("doc_id") % 5, printed_page_end=F.lit(1), physical_page_start=F.lit(7), physical_page_end=F.lit(7), content_type=F.when(F.col("doc_id") % 4 == 0, "novel"),
    )
    return doc.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").alias("seq"), "text", meta.alias("metadata"))


@query(sql.METADATA)
def metadata_violations(spark, d):
    return _described(spark, d).select("chunk_id", F.array_join(va.metadata_problems(), ",").alias("problems"))


@query(sql.CONTRACT)
def node_contract(spark, d):
    return va.node_violations(_described(spark, d)).groupBy("rule").agg(F.count("*").alias("n"))


@query(sql.GAPS)
def sequence_gaps(spark, d):
    """Order keys that lack between a customer's first and last order, by date."""
    o = tb.read(spark, d, "orders").select(F.col("o_custkey"), F.col("o_orderkey"))
    return va.sequence_gaps(o.filter("o_orderkey % 7 <> 0"), "o_orderkey", "o_orderkey").select("o_orderkey")


@query(sql.DELTAS)
def constant_delta(spark, d):
    rows = tb.lines(spark, d).withColumn("printed_page", F.when(F.col("physical_page") % 11 == 0, F.col("physical_page")).otherwise(F.col("physical_page") - 6))
    return va.inconstant_delta(rows, "physical_page", "printed_page", "physical_page", "doc").groupBy("doc").agg(F.count("*").alias("n"))


@query(sql.CATEGORIES)
def category_counts(spark, d):
    cases = tb.read(spark, d, "events").select(F.col("event_type").alias("category"))
    known = [r[0] for r in tb.read(spark, d, "region").select("r_name").orderBy("r_name").collect()]  # five names
    return va.category_counts(cases.union(tb.read(spark, d, "nation").join(tb.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name")), known)


# --- pages, sections, chunks ------------------------------------------------------------------


@query(sql.TITLES)
def html_title_links(spark, d):
    p = tb.read(spark, d, "pages")
    return p.select("page_id", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit(r"<a [^>]*href=\"([^\"]*)\""), F.lit(1))).alias("n_links"))


def _parsed(spark, d):
    return html.parse_pages(tb.read(spark, d, "pages"), "page_id", "url", root=("article", None))


@query()
def html_blocks(spark, d):
    return _parsed(spark, d).select("page_id", "title", F.posexplode_outer("blocks").alias("seq", "b")).select("page_id", "title", "seq", "b.kind", "b.level", "b.text")


@query()
def html_nodes(spark, d):
    return html.html_nodes(_parsed(spark, d), "page_id")


@query()
def html_chunks(spark, d):
    nodes = html.html_nodes(_parsed(spark, d), "page_id")
    c = html.html_chunks(nodes, F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".html")))
    return c.select("chunk_id", "text", "metadata.section_path", "token_count", "char_end")


@query()
def html_quality(spark, d):
    nodes = html.html_nodes(_parsed(spark, d), "page_id")
    return va.quality_counters(html.html_chunks(nodes, F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".html"))))


@query(sql.FILES)
def html_discovery(spark, d):
    p = tb.read(spark, d, "pages").select(F.col("url").alias("path"), "page_id")
    return readers.html_filter(p, index_pages=False).select("page_id", "file_name")


@query(sql.TREE)
def bookmark_tree(spark, d):
    t = sections.bookmark_tree(tb.bookmarks(spark, d))
    return t.select("doc", "ord", "level", "parent", "part", "chapter")


def _tree(spark, d, lines=None):
    lines = tb.lines(spark, d) if lines is None else lines
    t = sections.bookmark_tree(tb.bookmarks(spark, d, lines))
    totals = lines.groupBy("doc").agg(F.max("physical_page").alias("total_pages"))
    return sections.page_ranges(t, totals)


@query(sql.RANGES)
def next_boundary(spark, d):
    return _tree(spark, d).select("doc", "ord", "page_start", "page_end", "printed_end")


@query(sql.COVER)
def deepest_cover(spark, d):
    return sections.deepest_cover(tb.lines(spark, d), _tree(spark, d))


@query()
def section_descendants(spark, d):
    return sections.descendants(_tree(spark, d))


@query()
def heading_offsets(spark, d):
    return sections.heading_offsets(_tree(spark, d), tb.lines(spark, d)).select("doc", "ord", "heading_page", "heading_offset")


def _lines(spark, d):
    """Lines dealt out by document, from which trees and texts are made without moving them again."""
    return settle_by(tb.lines(spark, d), "lines", "doc")


def _located(spark, d, lines):
    return sections.heading_offsets(_tree(spark, d, lines), lines)


@query()
def structure_chunks(spark, d):
    lines = _lines(spark, d)
    return chunkers.structure_chunks(lines, _located(spark, d, lines), most=400, large=600)


@query()
def semantic_chunks(spark, d):
    lines = _lines(spark, d)
    return chunkers.semantic_chunks(lines, _tree(spark, d, lines), most=800)


@query()
def hybrid_chunks(spark, d):
    lines = _lines(spark, d)
    return chunkers.hybrid_chunks(lines, _located(spark, d, lines), most=400, large=600)


@query(sql.STRIDES)
def overlap_chunks(spark, d):
    c = chunkers.fixed_chunks(F.col("text"), 500, 50)
    return tb.read(spark, d, "documents").select("doc_id", F.posexplode(c).alias("piece", "text")).select("doc_id", "piece", F.md5("text").alias("digest"))


@query(sql.FILL)
def forward_fill(spark, d):
    """Each event with the last purchase of its user before it: an as-of join as a window."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    e = tb.read(spark, d, "events")
    return e.select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w).alias("last_purchase"))


@query(sql.JACCARD)
def char_jaccard_match(spark, d):
    q, p = tb.questions(spark, d), tb.read(spark, d, "part").select("p_type").distinct()
    pairs = q.crossJoin(F.broadcast(p)).withColumn("sim", F.round(numeric.char_jaccard(F.col("question"), F.col("p_type")), 6))  # part types are a closed list
    return pairs.groupBy("qid").agg(F.max("sim").alias("best"))


# --- audit ------------------------------------------------------------------------------------


def _questions(spark, d):
    return tb.read(spark, d, "documents").select(F.col("doc_id").alias("question_id"), F.substring("text", 1, 80).alias("question"))


@query(sql.MISSING)
def missing_annotations(spark, d):
    return audit.missing(_questions(spark, d), tb.annotations(spark, d))


def _findings(spark, d):
    return audit.audit(tb.annotations(spark, d), _questions(spark, d), tb.audited_nodes(spark, d))


@query()
def audit_findings(spark, d):
    return _findings(spark, d)


@query()
def audit_verdict(spark, d):
    return audit.audit_verdict(_findings(spark, d))


@query(sql.BOUNDS)
def source_bounds(spark, d):
    return audit.source_bounds(tb.audited_nodes(spark, d))


@query()
def interval_narrowing(spark, d):
    return audit.narrow(tb.annotations(spark, d), tb.audited_nodes(spark, d))


@query()
def narrowing_totals(spark, d):
    return audit.span_totals(audit.narrow(tb.annotations(spark, d), tb.audited_nodes(spark, d)))


@query(sql.WIDE)
def wide_intervals(spark, d):
    """Annotations checked against an interval with tolerance."""
    a = tb.annotations(spark, d)
    return a.select("question_id", numeric.in_interval(F.col("question_id") % 9, F.col("page_lo"), F.col("page_hi"), 2).alias("near"), (F.col("page_hi") - F.col("page_lo") > 100).alias("wide"))


# --- answers, logs, streams -------------------------------------------------------------------


@query(sql.JUDGES)
def judge_parse(spark, d):
    """Raw judge outputs of several kinds, parsed."""
    c = tb.read(spark, d, "conversations").withColumn("n", F.col("conv_id") % 8)
    raw = F.when(F.col("turn") % 3 == 0, F.format_string('{"score": %d, "rationale": "r"}', "n")).when(F.col("turn") % 3 == 1, F.format_string('score was "score": %d here', "n")).otherwise(F.col("text"))
    return c.select("conv_id", "turn", numeric.judge_score(raw).alias("j")).select("conv_id", "turn", F.round("j.score", 4).alias("score"), "j.raw_score", "j.parse_ok")


@query(sql.ABSTAIN)
def abstention(spark, d):
    c = tb.read(spark, d, "conversations").withColumn("answer", F.when(F.col("conv_id") % 5 == 0, F.concat("text", F.lit(" Not Found."))).otherwise(F.col("text")))
    return c.filter("role = 'assistant'").groupBy("conv_id").agg(F.count_if(tx.abstains(F.col("answer"))).alias("n_abstained"), F.count("*").alias("n"))


@query(sql.LAST_RECORD)
def source_log_hydrate(spark, d):
    log = tb.read(spark, d, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("seq"), F.col("text").alias("record"))
    rows = log.groupBy("request_id").agg(F.max_by("record", "seq").alias("record"))
    return rows.select("request_id", F.md5("record").alias("digest"))


@query(sql.SLICES)
def answer_slices(spark, d):
    a = tb.read(spark, d, "conversations").filter("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("request_id"), F.col("text").alias("answer"))
    return logs.answer_slices(a).groupBy("request_id").agg(F.count("*").alias("n"), F.sum(F.length("token")).alias("n_chars"))


@query(sql.WINDOWS)
def event_windows(spark, d):
    """The streaming aggregation, run over the table as a batch."""
    w = logs.windowed_counts(tb.read(spark, d, "events"), "1 day")
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query(sql.CHECKLIST)
def review_checklist(spark, d):
    rows = tb.read(spark, d, "documents").select("doc_id", "source")
    return writers.checklist(rows, "source", "doc_id").select("doc_id", "source", "n")


# --- sweeps and repairs -----------------------------------------------------------------------


@query(sql.BREACHES)
def filter_compliance(spark, d):
    """Unfiltered hits that a filter would have kept out, per question."""
    return mt.filter_breaches(_bm25(spark, d), tb.nodes(spark, d), {"version": "en"}).groupBy("qid").agg(F.count("*").alias("n"))


@query(sql.CORRECTED)
def corrections(spark, d):
    docs = tb.read(spark, d, "documents").select("doc_id", "lang", "source")
    fixes = docs.filter("doc_id % 7 = 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "xx").alias("lang"))
    return mt.corrected(docs, fixes, "doc_id")


@query(sql.SCOPES)
def change_scope(spark, d):
    p = tb.read(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return p.select("page_id", mt.change_scope(F.col("path"), ("www.",), ("m.", "blog.")).alias("scope"))


@query(sql.HISTOGRAM)
def type_histogram(spark, d):
    return mt.histogram(tb.read(spark, d, "events"), "event_type")


@query(sql.GREP)
def node_grep(spark, d):
    return mt.grep(tb.nodes(spark, d), "token")


@query(sql.SUITE)
def abstention_suite(spark, d):
    return mt.abstention_suite(tb.read(spark, d, "conversations").select(F.concat("text", F.lit(" not found")).alias("answer")))


@query(sql.ANSWERS)
def answer_evaluation(spark, d):
    """Answers and judges that are columns: the context's first words, and its length as a score."""
    q = tb.questions(spark, d)
    contexts = q.filter("qid % 3 <> 0").select("qid", F.col("question").alias("context"))
    rows = mt.evaluate_answers(q, contexts, lambda a, c: F.substring(c, 1, 20), {"faithfulness": lambda a, c, x: F.format_string('{"score": %d}', F.length(a) % 6)})
    return rows.groupBy("metric").agg(F.round(F.avg("score"), 4).alias("mean"), F.count_if("parse_ok").alias("n"), F.count_if("abstained").alias("n_abstained"))


# --- lifecycle --------------------------------------------------------------------------------


@query(sql.HYBRID)
def hybrid_topk(spark, d):
    """Terms of a document and the vector of its number, fused; a question's vector is that of its own number."""
    asked = tb.vectors(spark, d).select(F.col("node_id").alias("qid"), F.col("embedding").alias("q")).join(tb.questions(spark, d).select("qid"), "qid", "left_semi")
    nodes = tb.nodes(spark, d)
    return rt.retrieve("hybrid", tb.questions(spark, d), nodes, index=rt.build_bm25(nodes), vectors=tb.vectors(spark, d), question_vectors=asked)


@query(sql.REQUESTS)
def request_problems(spark, d):
    """Turns of conversations as requests."""
    found = lc.request_problems(F.col("text"), F.col("turn"), F.col("role"))
    rows = tb.read(spark, d, "conversations").select("conv_id", "turn", found.alias("p"))
    return rows.select("conv_id", "turn", *[F.array_contains("p", x).alias(f"bad_{x}") for x in ("question", "top_k", "experiment")])


@query(sql.RECORDS)
def retrieval_records(spark, d):
    q = tb.questions(spark, d)
    return lc.retrieval_records(q, rt.mock_hits(q.filter("qid % 3 <> 0"), 5), 3, mode="mock").select("qid", "mode", "top_k", "result_count")


@query(sql.STATISTICS)
def document_statistics(spark, d):
    """Labels as chunks, short documents as skipped ones."""
    docs = tb.read(spark, d, "documents")
    return lc.document_statistics(docs.select("doc_id"), tb.read(spark, d, "pages"), tb.read(spark, d, "labels"), docs.filter(F.length("text") < 100), key="doc_id")


@query(sql.EVIDENCE)
def missing_evidence(spark, d):
    return lc.missing_evidence(tb.questions(spark, d).select(F.col("qid").alias("node_id")), tb.read(spark, d, "labels").select(F.col("doc_id").alias("chunk_id")))


FLAGSHIP = bm25_topk_metrics
