"""Section trees over bookmarks: parents, paths, page ranges, heading offsets, covering sections.

A tree is a table (doc, ord, level, title, ...) in document order.  Stack rules of a sequential
reader become window frames: the parent is the last earlier row of a smaller level, the boundary the
first later row of a level not larger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import numeric, text as tx

LEVELS = range(1, 6)
PAGE_WINDOW, LEAST_SIMILARITY = 1, 0.8
BOUNDARY = ("heading_page", "heading_offset", "page_start")


def by_level(level: Column, values: dict[int, Column]) -> Column:
    out = F.lit(None)
    for n, v in values.items():
        out = F.when(level == n, v).otherwise(out)
    return out


def bookmark_tree(bookmarks: DataFrame) -> DataFrame:
    """(doc, ord, level, title, page, parent, part, chapter, section_path, node_id) of (doc, seq, page, level, title).

    Bookmarks of one page go by level, then in their order; levels outside 1 to 5 are dropped.
    """
    rows = bookmarks.filter(F.col("level").between(1, 5)).withColumn("title", tx.strip(F.col("title")))
    rows = rows.withColumn("ord", F.row_number().over(W.partitionBy("doc").orderBy("page", "level", "seq")))  # one document's bookmarks
    before = W.partitionBy("doc").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    level = F.col("level")
    rows = rows.withColumn("parent", by_level(level, {n: F.max(F.when(level < n, F.col("ord"))).over(before) for n in LEVELS}))
    upto = W.partitionBy("doc").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    for n in LEVELS:
        rows = rows.withColumn(f"a{n}", F.last(F.when(level == n, F.struct("ord", "title")), ignorenulls=True).over(upto))
    for n in reversed(LEVELS):
        cut = F.greatest(F.lit(-1), F.lit(-1), *[F.coalesce(F.col(f"a{m}.ord"), F.lit(-1)) for m in LEVELS if m < n])
        rows = rows.withColumn(f"a{n}", F.when((F.col(f"a{n}.ord") > cut) & (level >= n), F.col(f"a{n}")))
    own = [F.when((level >= n) | F.lit(n > 3), F.col(f"a{n}.title")) for n in LEVELS]
    rows = rows.withColumn("section_path", tx.section_path(*own))
    rows = rows.withColumn("part", F.coalesce("a1.title", F.lit(""))).withColumn("chapter", F.coalesce("a2.title", F.lit("")))
    return rows.withColumn("node_id", tx.slug(F.col("section_path"), 200)).drop(*[f"a{n}" for n in LEVELS])


def with_boundaries(tree: DataFrame, *columns: str) -> DataFrame:
    """``tree`` with ``boundary``: the given columns of the first later row whose level isn't larger."""
    after = W.partitionBy("doc").orderBy("ord").rowsBetween(1, W.unboundedFollowing)
    level = F.col("level")
    row = F.struct("ord", *columns)
    return tree.withColumn("boundary", by_level(level, {n: F.min(F.when(level <= n, row)).over(after) for n in LEVELS}))


def page_ranges(tree: DataFrame, totals: DataFrame, offset: int = -6) -> DataFrame:
    """``tree`` with page_start, page_end and printed_end; a section reaches the page where the next one starts."""
    rows = with_boundaries(tree, "page").join(totals.select("doc", "total_pages"), "doc")
    end = F.when(F.col("boundary").isNotNull(), F.greatest("page", F.col("boundary.page"))).otherwise(F.col("total_pages"))
    return rows.withColumn("page_start", F.col("page")).withColumn("page_end", end).withColumn("printed_end", end + offset).drop("boundary", "total_pages")


def title_candidates(spans: DataFrame, least: int = 2, tolerance: float = 0.5) -> DataFrame:
    """(doc, page, line, level, title) from layout spans (doc, page, line, seq, text, size, font).

    A line is a candidate by its number, or as level 4 if it is bold and about as large as the
    third largest size of its document.
    """
    sizes = spans.select("doc", F.round("size", 1).alias("s")).distinct().groupBy("doc").agg(F.slice(F.sort_array(F.collect_set("s"), False), 1, 3).alias("top"))  # sizes of fonts
    lines = spans.groupBy("doc", "page", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("title"), F.max("size").alias("size"), F.bool_or(F.lower("font").contains("bold")).alias("bold"))
    lines = lines.withColumn("title", tx.strip(F.col("title"))).filter(F.length("title") >= least).join(sizes, "doc")
    level = F.coalesce(tx.heading_level(F.col("title")), F.when((F.col("size") + tolerance >= F.array_min("top")) & F.col("bold"), 4))
    return lines.withColumn("level", level).filter("level IS NOT NULL").select("doc", "page", "line", "level", "title", "size", "bold")


def verify_titles(tree: DataFrame, candidates: DataFrame) -> DataFrame:
    """``tree`` with verified: a candidate within a page and of the same level has the title as its best match.

    The band becomes an equi-join: each candidate is repeated for the pages it may match.
    """
    near = candidates.select("doc", "level", "line", F.col("page").alias("at"), F.col("title").alias("seen"), F.explode(F.sequence(F.col("page") - PAGE_WINDOW, F.col("page") + PAGE_WINDOW)).alias("page"))
    pairs = near.join(tree.select("doc", "level", "page", "ord", "title"), ["doc", "level", "page"]).withColumn("sim", numeric.char_jaccard(F.col("title"), F.col("seen")))
    best = pairs.groupBy("doc", "at", "line", "level").agg(F.max(F.struct("sim", -F.col("page"), -F.col("ord"))).alias("b"))
    found = best.filter(F.col("b.sim") >= LEAST_SIMILARITY).select("doc", (-F.col("b.col3")).alias("ord")).distinct().withColumn("verified", F.lit(True))
    return tree.join(found, ["doc", "ord"], "left").withColumn("verified", F.coalesce("verified", F.lit(False)))


def heading_offsets(tree: DataFrame, pages: DataFrame) -> DataFrame:
    """``tree`` with heading_page and heading_offset (null if not found).

    The title is looked for without regard to white space on its page, the next and the one before.
    """
    tries = tree.select("doc", "ord", "title", F.posexplode(F.array(F.col("page"), F.col("page") + 1, F.col("page") - 1)).alias("try", "page"))
    bare = F.regexp_replace("title", r"\s+", "")
    letters = F.filter(F.split(bare, ""), lambda c: c != "")
    pattern = F.array_join(F.transform(letters, lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))), r"\s*")
    found = tries.join(pages.select("doc", F.col("physical_page").alias("page"), "text"), ["doc", "page"]).withColumn("at", F.regexp_instr("text", pattern))
    best = found.filter((F.col("at") > 0) & (bare != "")).groupBy("doc", "ord").agg(F.min(F.struct("try", "page", (F.col("at") - 1).alias("offset"))).alias("h"))
    return tree.join(best, ["doc", "ord"], "left").withColumn("heading_page", F.col("h.page")).withColumn("heading_offset", F.col("h.offset")).drop("h")


def deepest_cover(pages: DataFrame, tree: DataFrame) -> DataFrame:
    """(doc, physical_page, ord): the deepest section over each page, the first of equals; pages without one drop out.

    Page intervals are short and whole numbers, so the range join is an equi-join on exploded pages.
    """
    covered = tree.filter("page_start <= page_end").select("doc", "ord", "level", F.explode(F.sequence("page_start", "page_end")).alias("physical_page"))
    best = covered.groupBy("doc", "physical_page").agg(F.min(F.struct(-F.col("level"), "ord")).alias("b")).select("doc", "physical_page", F.col("b.ord").alias("ord"))
    return pages.select("doc", "physical_page").join(best, ["doc", "physical_page"])


def descendants(tree: DataFrame) -> DataFrame:
    """(doc, ord, child): direct subsections, that is descendants by path and pages without one in between."""
    a = tree.select("doc", "ord", F.col("section_path").alias("p"), F.col("page_start").alias("s"), F.col("page_end").alias("e"))
    b = tree.select("doc", F.col("ord").alias("child"), F.col("section_path").alias("q"), F.col("page_start").alias("t"), F.col("page_end").alias("f"))
    # ancestors' paths are the prefixes of a path: an equi-join, no comparison of all pairs
    parts = F.split("q", tx.SECTION_SEPARATOR)
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), tx.SECTION_SEPARATOR))
    pairs = b.withColumn("p", F.explode(above)).filter("p <> q").join(a, ["doc", "p"]).filter("t >= s AND f <= e")
    nearest = pairs.groupBy("doc", "child").agg(F.max_by("ord", F.length("p")).alias("ord"))
    return nearest.select("doc", "ord", "child")


def section_texts(tree: DataFrame, pages: DataFrame, *, whole_pages: bool = False) -> DataFrame:
    """(doc, ord, text): pages of each section, cut at its own heading and at its boundary's."""
    return bounded_texts(with_boundaries(tree, *BOUNDARY), pages, whole_pages=whole_pages)


def bounded_texts(tree: DataFrame, pages: DataFrame, *, whole_pages: bool = False) -> DataFrame:
    """As :func:`section_texts`, of sections whose ``boundary`` is known."""
    start = lambda p: F.struct(F.coalesce(F.col(f"{p}heading_page"), F.col(f"{p}page_start")).alias("page"), F.when(F.col(f"{p}heading_page").isNotNull(), F.col(f"{p}heading_offset")).otherwise(0).alias("offset"))
    rows = tree.withColumn("a", start("")).withColumn("z", F.when(F.col("boundary").isNotNull(), start("boundary.")))
    last = F.when(F.lit(whole_pages) | F.col("z").isNull(), F.col("page_end")).otherwise(F.least("page_end", F.col("z.page")))
    first = F.col("page_start") if whole_pages else F.col("a.page")
    each = rows.select("doc", "ord", "a", "z", "page_end", F.explode(F.sequence(first, F.greatest(last, first))).alias("physical_page"))
    each = each.join(pages.select("doc", "physical_page", "text"), ["doc", "physical_page"])
    low = F.when((F.col("physical_page") == F.col("a.page")) & F.lit(not whole_pages), F.col("a.offset")).otherwise(0)
    high = F.when((F.col("physical_page") == F.col("z.page")) & F.lit(not whole_pages), F.col("z.offset")).otherwise(F.length("text"))
    piece = tx.strip(F.substring(F.col("text"), low + 1, F.greatest(high - low, F.lit(0))))
    parts = each.select("doc", "ord", "physical_page", piece.alias("piece")).filter("piece <> ''").groupBy("doc", "ord").agg(F.array_sort(F.collect_list(F.struct("physical_page", "piece"))).alias("ps"))  # one section's pages
    return parts.select("doc", "ord", F.array_join(F.transform("ps", lambda p: p["piece"]), "\n\n").alias("text"))
