"""Annotation audit and interval narrowing: findings are rows of (question_id, code)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.sized import sized_broadcast
from ..sources.stored import settle
from .matching import find_terms

TOLERANCE = 2
#: Codes that block a data set (fixed values).
BLOCKING = (
    "CONTRACT_UNKNOWN_QUESTION_ID", "CONTRACT_NO_CONDITION", "CONTRACT_UNKNOWN_SOURCE", "CONTRACT_MISSING", "HTML_PAGE_SHOULD_BE_NULL",
    "PAGE_OUT_OF_RANGE", "PAGE_NO_CHUNK", "PAGE_INVALID", "TERM_NOT_FOUND", "SECTION_PAGE_MISMATCH", "TERM_PAGE_MISMATCH",
)


def term_pages(terms: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source_id, term, page) of each page whose node text holds a term, white space and case apart.

    ``terms`` (source_id, term) is a stated query set; only nodes of its sources meet it.  Nodes
    without pages are invisible.
    """
    bodies = nodes.filter("printed_page_start IS NOT NULL AND printed_page_end IS NOT NULL").select("source_id", F.lit(0).alias("rank"), F.col("printed_page_start").alias("lo"), F.col("printed_page_end").alias("hi"), "text")
    hits = find_terms(bodies, terms)
    return hits.select("source_id", "term", F.explode(F.sequence("lo", "hi")).alias("page")).distinct()


def source_bounds(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("source_id").agg(F.min("printed_page_start").alias("lo"), F.max("printed_page_end").alias("hi"))


def section_spans(keywords: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source_id, keyword, s_lo, s_hi, in_title): the first section whose title equals or contains the keyword.

    ``nodes`` needs ord, the place in the document.
    """
    titled = nodes.select("source_id", F.col("ord").alias("rank"), F.col("printed_page_start").alias("lo"), F.col("printed_page_end").alias("hi"), F.concat_ws(" ", "title", "section_path").alias("text"))
    first = find_terms(titled, keywords.select("source_id", F.col("keyword").alias("term")), first=True)
    return first.select("source_id", F.col("term").alias("keyword"), F.col("lo").alias("s_lo"), F.col("hi").alias("s_hi"), F.lit(True).alias("in_title"))


def audit(annotations: DataFrame, questions: DataFrame, nodes: DataFrame, top1: DataFrame | None = None, tolerance: int = TOLERANCE) -> DataFrame:
    """(question_id, code) findings of annotations against what the corpus holds.

    ``annotations``: question_id, source_id, page_lo, page_hi, page_is_scalar, section_keyword;
    ``questions``: question_id, question; ``nodes``: source_id, ord, text, title, section_path,
    printed_page_start, printed_page_end; ``top1``: question_id, page of the first hit.
    """
    a = annotations.withColumn("aid", F.monotonically_increasing_id())
    a = settle(a.join(questions.withColumn("known", F.lit(True)), "question_id", "left").withColumn("known", F.coalesce("known", F.lit(False))), "annotations")
    none = F.coalesce(F.col("source_id") == "", F.lit(True)) & F.col("page_lo").isNull() & F.col("page_hi").isNull() & F.coalesce(F.col("section_keyword") == "", F.lit(True))
    find = lambda df, code: df.select("question_id", F.lit(code).alias("code"))
    out = find(a.filter("NOT known"), BLOCKING[0]).union(find(a.filter(none), "CONTRACT_NO_CONDITION"))
    a = a.filter(~none)
    bounds = source_bounds(nodes)
    b = a.join(bounds.withColumn("has", F.lit(True)), "source_id", "left")
    out = out.union(find(b.filter("source_id <> '' AND has IS NULL"), "CONTRACT_UNKNOWN_SOURCE"))
    out = out.union(find(b.filter("source_id <> '' AND lo IS NULL AND page_lo IS NOT NULL"), "HTML_PAGE_SHOULD_BE_NULL"))
    out = out.union(find(b.filter("(page_lo IS NULL) <> (page_hi IS NULL) OR page_lo > page_hi"), "PAGE_INVALID"))
    out = out.union(find(b.filter("page_lo < lo OR page_hi > hi"), "PAGE_OUT_OF_RANGE"))
    inside = b.filter("page_lo >= lo AND page_hi <= hi AND page_lo <= page_hi").select("aid", "question_id", "source_id", F.explode(F.sequence("page_lo", "page_hi")).alias("page"))
    pages = nodes.filter("printed_page_start IS NOT NULL").select("source_id", F.explode(F.sequence("printed_page_start", "printed_page_end")).alias("page")).distinct()
    seen = inside.join(pages, ["source_id", "page"], "left_semi").select("aid").distinct()
    out = out.union(find(inside.select("aid", "question_id").distinct().join(seen, "aid", "left_anti"), "PAGE_NO_CHUNK"))

    k = a.filter("section_keyword <> ''").select("aid", "question_id", "source_id", "page_lo", "page_hi", F.col("section_keyword").alias("keyword"))
    t = a.withColumn("tokens", tx.identifiers(F.coalesce("question", F.lit(""))))
    out = out.union(find(t.filter(F.size("tokens") == 0), "NO_TOKEN_PROBE"))
    t = t.filter("source_id <> '' AND page_lo IS NOT NULL").select("aid", "question_id", "source_id", "page_lo", "page_hi", F.explode("tokens").alias("term"))
    spans = section_spans(k.select("source_id", "keyword"), nodes)
    # keywords and tokens are looked up together, so that texts are read once
    where = settle(term_pages(k.select("source_id", F.col("keyword").alias("term")).union(t.select("source_id", "term")), nodes), "term-pages")
    near = k.join(where.withColumnRenamed("term", "keyword"), ["source_id", "keyword"]).groupBy("aid").agg(F.bool_or(F.col("page").between(F.col("page_lo") - tolerance, F.col("page_hi") + tolerance)).alias("near"))
    k = k.join(spans, ["source_id", "keyword"], "left").join(near.withColumn("in_text", F.lit(True)), "aid", "left")
    out = out.union(find(k.filter("in_title IS NULL AND in_text IS NULL"), "TERM_NOT_FOUND"))
    out = out.union(find(k.filter(f"page_hi < s_lo - {tolerance} OR page_lo > s_hi + {tolerance}"), "SECTION_PAGE_MISMATCH"))
    out = out.union(find(k.filter("page_lo IS NOT NULL AND in_text AND NOT near"), "TERM_PAGE_MISMATCH"))

    found = t.join(where, ["source_id", "term"]).groupBy("aid", "term").agg(F.bool_or(F.col("page").between(F.col("page_lo") - tolerance, F.col("page_hi") + tolerance)).alias("near"))
    t = t.join(found, ["aid", "term"], "left").groupBy("aid", "question_id").agg(F.bool_or(F.col("near").isNull()).alias("absent"), F.bool_or(F.coalesce(~F.col("near"), F.lit(False))).alias("off"))
    out = out.union(find(t.filter("absent"), "QUESTION_TOKEN_ABSENT")).union(find(t.filter("off"), "QUESTION_TOKEN_OFF_PAGE"))
    if top1 is not None:
        first = top1.select("question_id", F.col("page").alias("p1"))
        out = out.union(find(a.join(first, "question_id").filter("page_is_scalar AND page_lo = p1"), "CIRCULAR_TOP1"))
    return out.union(missing(questions, annotations))


def missing(questions: DataFrame, annotations: DataFrame) -> DataFrame:
    """Questions without an annotation."""
    return questions.select("question_id").join(annotations.select("question_id"), "question_id", "left_anti").withColumn("code", F.lit("CONTRACT_MISSING"))


def audit_verdict(findings: DataFrame) -> DataFrame:
    """One row: verdict, findings and blocking ones; missing annotations count twice among these, once by code and once as a set."""
    blocking = F.col("code").isin(*BLOCKING)
    total = F.count_if(blocking) + F.count_if(F.col("code") == "CONTRACT_MISSING")
    return findings.agg(F.count("*").alias("n_findings"), total.alias("blocking_total"), F.count_if(F.col("code") == "CIRCULAR_TOP1").alias("n_circular")).withColumn("verdict", F.when(F.col("blocking_total") > 0, "blocked").otherwise("pass"))


def sections_by_number(nodes: DataFrame) -> DataFrame:
    """(source_id, num, lo, hi, body): nodes by section number, texts of subsections rolled into every section above."""
    own = nodes.withColumn("num", tx.section_number(F.col("title"))).filter("num IS NOT NULL")
    parts = F.split("num", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    up = own.select("source_id", "ord", "text", "printed_page_start", "printed_page_end", F.col("num").alias("own"), F.explode(above).alias("num"))
    mine = F.col("own") == F.col("num")
    return up.groupBy("source_id", "num").agg(
        F.min(F.when(mine, F.col("printed_page_start"))).alias("lo"), F.max(F.when(mine, F.col("printed_page_end"))).alias("hi"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", tx.squeeze(F.col("text")).alias("b")))), lambda x: x["b"]), "").alias("body"),
    ).filter("lo IS NOT NULL")


def narrow(annotations: DataFrame, nodes: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Annotations with the interval of the section they name: an override first, then by number, else by first path that holds the keyword."""
    s = sections_by_number(nodes).select("source_id", "num", F.col("lo").alias("n_lo"), F.col("hi").alias("n_hi"))
    a = annotations.withColumn("num", tx.section_number(F.col("section_keyword")))
    paths = section_spans(a.select("source_id", F.col("section_keyword").alias("keyword")), nodes).withColumnRenamed("keyword", "section_keyword")
    rows = a.join(s, ["source_id", "num"], "left").join(paths, ["source_id", "section_keyword"], "left")
    if overrides is not None:
        rows = rows.join(overrides.select("question_id", F.col("page_lo").alias("o_lo"), F.col("page_hi").alias("o_hi")), "question_id", "left")
    else:
        rows = rows.withColumn("o_lo", F.lit(None).cast("int")).withColumn("o_hi", F.lit(None).cast("int"))
    lo, hi = F.coalesce("o_lo", "n_lo", "s_lo", "page_lo"), F.coalesce("o_hi", "n_hi", "s_hi", "page_hi")
    return rows.select("question_id", "source_id", "section_keyword", F.col("page_lo").alias("old_lo"), F.col("page_hi").alias("old_hi"), lo.alias("page_lo"), hi.alias("page_hi"))


def span_totals(narrowed: DataFrame) -> DataFrame:
    before, now = F.col("old_hi") - F.col("old_lo"), F.col("page_hi") - F.col("page_lo")
    return narrowed.agg(F.count("*").alias("n"), F.sum(before).alias("pages_before"), F.sum(now).alias("pages_now"), F.round(F.avg(before), 4).alias("avg_before"), F.round(F.avg(now), 4).alias("avg_now"), F.count_if((now != before)).alias("changed"))


def question_matches(questions: DataFrame, nodes: DataFrame, n_words: int = 5, limit: int = 3) -> DataFrame:
    """(question_id, node_id): up to ``limit`` nodes whose text holds one of a question's first words.

    The words meet the nodes' words in an equi-join, since a word of a node is what can hold it.
    """
    words = questions.select("question_id", F.explode(F.slice(F.split(tx.strip(F.lower("question")), r"\s+"), 1, n_words)).alias("word")).filter("word <> ''").distinct()
    own = nodes.select("node_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("word"))
    hits = own.join(sized_broadcast(words), "word").select("question_id", "node_id").distinct()
    from pyspark.sql import Window as W

    ranked = hits.withColumn("r", F.row_number().over(W.partitionBy("question_id").orderBy("node_id")))
    return ranked.filter(F.col("r") <= limit).drop("r")
