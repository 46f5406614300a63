"""Chunkers: structure, semantic and hybrid, as functions of pages and a section tree.

``pages`` is (doc, physical_page, printed_page, text); ``tree`` comes from
:mod:`scriptorium.operators.sections` with page ranges and heading offsets.  Each chunker returns
(doc, ord, chunk_no, text, chunk_id, page).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import numeric, text as tx
from ..sources.stored import settle, settle_by
from . import sections
from .html import cut_text

MAX_CHARS, LARGE, LEAST, OVERLAP, PERCENTILE = 2500, 3000, 20, 200, 0.95
SEGMENTS = T.ArrayType(T.StringType())


def _assemble(segments, most: int) -> list[str]:
    """Atomic segments alone, others packed up to ``most`` characters."""
    out: list[str] = []
    room = False
    for s in segments:
        for part in [s["text"]] if s["atomic"] or len(s["text"]) <= most else cut_text(s["text"], most):
            if room and not s["atomic"] and len(out[-1]) + len(part) <= most:
                out[-1] += part
            else:
                out.append(part)
            room = not s["atomic"]
    return [p.strip() for p in out if p.strip()]


def assembler(most: int):
    return F.udf(lambda segments: _assemble(segments or [], most), SEGMENTS, useArrow=False)


def splitter(most: int, overlap: int):
    """Overlapping cuts at the last new line or full stop of a window's second half."""
    return F.udf(lambda s: cut_text(s or "", most, overlap, ("\n", "。")), SEGMENTS, useArrow=True)


def fixed_chunks(text: Column, size: int, overlap: int = 0) -> Column:
    """Array of strides of ``size`` characters, each starting ``size - overlap`` after the last."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(size - overlap))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))


def structure_chunks(pages: DataFrame, tree: DataFrame, *, most: int = MAX_CHARS, large: int = LARGE, whole_pages: bool = False, prefix: str = "struct_v1") -> DataFrame:
    """Chunks per level-3 section; large ones along their direct subsections, with the lead before the first."""
    tree = settle_by(tree, "tree", "doc")
    texts = settle_by(sections.section_texts(tree, pages, whole_pages=whole_pages), "section-texts", "doc")
    size = texts.select("doc", "ord", F.length("text").alias("size"))
    kids = settle_by(sections.descendants(tree).join(tree.select("doc", F.col("ord").alias("child"), F.col("level").alias("child_level")), ["doc", "child"]), "subsections", "doc")
    units = tree.filter("level = 3").select("doc", "ord").join(size, ["doc", "ord"])
    inner = kids.filter("child_level IN (4, 5)")
    split = units.filter(F.col("size") > large).join(inner.select("doc", "ord").distinct(), ["doc", "ord"], "left_semi")
    second = split.select("doc", "ord").join(inner, ["doc", "ord"]).select("doc", F.col("child").alias("ord"), F.col("child_level").alias("level")).join(size, ["doc", "ord"])
    deep = second.filter((F.col("level") == 4) & (F.col("size") > most)).join(inner.select("doc", "ord").distinct(), ["doc", "ord"], "left_semi")
    third = deep.select("doc", "ord").join(inner, ["doc", "ord"]).select("doc", F.col("child").alias("ord"))
    used = units.select("doc", "ord").join(split, ["doc", "ord"], "left_anti").union(second.select("doc", "ord").join(deep, ["doc", "ord"], "left_anti")).union(third)
    # unions forget how their parts are dealt out: those of numbers are dealt out anew, those of texts come last
    used = settle_by(used.distinct(), "used-sections", "doc")
    placed = tree.select("doc", "ord", "node_id", "page_start")
    bodies = used.join(texts, ["doc", "ord"]).join(placed, ["doc", "ord"])
    # a lead is the section cut at its first subsection
    parents = settle_by(split.select("doc", "ord").union(deep.select("doc", "ord")).distinct(), "lead-sections", "doc")
    first = parents.join(inner, ["doc", "ord"]).groupBy("doc", "ord").agg(F.min("child").alias("child"))
    heads = tree.select("doc", F.col("ord").alias("child"), *[F.col(c).alias(f"b_{c}") for c in sections.BOUNDARY])
    own = tree.select("doc", "ord", "title", "page_start", "page_end", "heading_page", "heading_offset").join(first, ["doc", "ord"]).join(heads, ["doc", "child"])
    own = own.withColumn("boundary", F.when(F.col("child") > F.col("ord"), F.struct(F.col("child").alias("ord"), *[F.col(f"b_{c}").alias(c) for c in sections.BOUNDARY])))
    leads = sections.bounded_texts(own, pages).join(own.select("doc", "ord", "title"), ["doc", "ord"])
    leads = leads.filter(tx.squeeze(F.col("text")) != tx.squeeze(F.col("title"))).select("doc", "ord", "text").join(placed, ["doc", "ord"])
    bodies = bodies.unionByName(leads)
    rows = bodies.select("doc", "ord", "node_id", "page_start", F.posexplode(assembler(most)(tx.atomic_segments(F.col("text")))).alias("chunk_no", "text"))
    return rows.select("doc", "ord", "chunk_no", "text", F.format_string(f"{prefix}_%s_%05d", "node_id", "chunk_no").alias("chunk_id"), F.col("page_start").alias("page"))


def semantic_breaks(sentences: DataFrame, embed: Callable[[Column], Column] = numeric.hash_vector, percentile: float = PERCENTILE) -> DataFrame:
    """``sentences`` (doc, seq, sentence) with ``part``, the number of the run that a sentence is in.

    Sentences are embedded together with their neighbours; a run ends where the distance to the
    next one is above the document's percentile.
    """
    w = W.partitionBy("doc").orderBy("seq")  # one document's sentences
    if embed is numeric.hash_vector:  # counts of words add up, so that each sentence is cut once; its numbers are taken one by one
        at = lambda c: [F.get(F.col(c), F.lit(i)) for i in range(numeric.DIMS)]
        total = lambda xs: reduce(Column.__add__, xs, F.lit(0.0))
        rows = sentences.withColumn("e", embed(F.col("sentence"))).withColumn("e1", F.lag("e").over(w)).withColumn("e2", F.lead("e").over(w))
        rows = rows.withColumn("v", F.array(*[x + F.coalesce(y, F.lit(0.0)) + F.coalesce(z, F.lit(0.0)) for x, y, z in zip(at("e"), at("e1"), at("e2"), strict=True)])).drop("e", "e1", "e2")
        norm, dot = F.sqrt(total(x * x for x in at("v"))), total(x * y for x, y in zip(at("v"), at("next_v"), strict=True))
    else:
        near = F.concat(F.coalesce(F.lag("sentence").over(w), F.lit("")), F.lit(" "), F.col("sentence"), F.lit(" "), F.coalesce(F.lead("sentence").over(w), F.lit("")))
        rows = sentences.withColumn("v", embed(near))
        norm, dot = numeric.norm(F.col("v")), numeric.dot(F.col("v"), F.col("next_v"))
    rows = rows.withColumn("nv", norm).withColumn("next_v", F.lead("v").over(w)).withColumn("next_nv", F.lead("nv").over(w))
    rows = rows.withColumn("distance", F.round(1 - F.coalesce(F.try_divide(dot, F.col("nv") * F.col("next_nv")), F.lit(0.0)), 9))
    rows = rows.withColumn("distance", F.when(F.col("next_v").isNotNull(), F.col("distance"))).drop("v", "nv", "next_v", "next_nv")
    # a window, as a join with the limits would make all distances twice
    rows = rows.withColumn("limit", F.percentile("distance", percentile).over(W.partitionBy("doc"))).withColumn("ends", (F.coalesce(F.col("distance") > F.col("limit"), F.lit(False))).cast("int"))
    return rows.withColumn("part", F.coalesce(F.sum("ends").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("limit", "ends")


def semantic_chunks(pages: DataFrame, tree: DataFrame, *, embed: Callable[[Column], Column] = numeric.hash_vector, most: int = MAX_CHARS, least: int = LEAST, overlap: int = OVERLAP, prefix: str = "semantic_v1") -> DataFrame:
    """Runs of similar sentences over the pages that a section covers; a chunk's page is its first sentence's."""
    covered = sections.deepest_cover(pages, tree)
    rows = pages.join(covered, ["doc", "physical_page"]).filter(~tx.is_blank(F.col("text")))
    rows = rows.select("doc", "physical_page", "ord", F.posexplode(tx.sentences(F.col("text"))).alias("n", "sentence"))
    rows = rows.withColumn("seq", F.struct("physical_page", "n"))
    parts = semantic_breaks(rows, embed).groupBy("doc", "part").agg(F.array_sort(F.collect_list(F.struct("seq", "sentence", "ord"))).alias("ss"))
    body = F.array_join(F.transform("ss", lambda s: s["sentence"]), "\n")
    parts = parts.select("doc", "part", body.alias("text"), F.col("ss")[0]["ord"].alias("ord"), F.col("ss")[0]["seq"]["physical_page"].alias("page"))
    parts = parts.withColumn("chunk_no", F.row_number().over(W.partitionBy("doc").orderBy("part")) - 1).filter(F.length("text") >= least)
    base = F.format_string(f"{prefix}_%05d", "chunk_no")
    return _capped(parts.withColumn("chunk_id", base), most, overlap)


def _capped(chunks: DataFrame, most: int, overlap: int) -> DataFrame:
    """Chunks over ``most`` characters cut with overlap, as <id>_p<n>."""
    long = F.length("text") > most
    pieces = F.when(long, splitter(most, overlap)("text")).otherwise(F.array("text"))
    rows = chunks.withColumn("long", long).select("doc", "ord", "chunk_no", "chunk_id", "page", "long", F.posexplode(pieces).alias("p", "text"))
    return rows.select("doc", "ord", "chunk_no", "text", F.when(F.col("long"), F.format_string("%s_p%03d", "chunk_id", "p")).otherwise(F.col("chunk_id")).alias("chunk_id"), "page")


def hybrid_chunks(pages: DataFrame, tree: DataFrame, *, embed: Callable[[Column], Column] = numeric.hash_vector, most: int = MAX_CHARS, large: int = LARGE, overlap: int = OVERLAP) -> DataFrame:
    """Structure first, over whole pages; what is still over ``most`` is cut by meaning, then by length."""
    rows = structure_chunks(pages, tree, most=most, large=large, whole_pages=True, prefix="hybrid_v1")
    rows = settle(rows, "hybrid")
    long = rows.filter(F.length("text") > most)
    cut = long.select("ord", "chunk_no", "page", F.col("chunk_id").alias("doc"), F.col("doc").alias("d"), F.posexplode(tx.sentences(F.col("text"))).alias("seq", "sentence"))
    parts = semantic_breaks(cut, embed).groupBy("doc", "d", "ord", "chunk_no", "page", "part").agg(F.array_sort(F.collect_list(F.struct("seq", "sentence"))).alias("ss"))
    parts = parts.select(F.col("d").alias("doc"), "ord", "chunk_no", F.array_join(F.transform("ss", lambda s: s["sentence"]), "\n").alias("text"), F.format_string("%s_sem%03d", "doc", "part").alias("chunk_id"), "page")
    return rows.filter(F.length("text") <= most).unionByName(_capped(parts, most, overlap))


CHUNKERS = {"structure": structure_chunks, "semantic": semantic_chunks, "hybrid": hybrid_chunks}


def get_chunker(strategy: str) -> Callable[..., DataFrame]:
    if strategy not in CHUNKERS:
        raise ValueError(f"unknown strategy {strategy!r}; known: {', '.join(CHUNKERS)}")
    return CHUNKERS[strategy]
