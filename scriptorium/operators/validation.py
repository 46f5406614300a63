"""Contracts and quality reports: violations are rows, never exceptions inside a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import text as tx

# The metadata contract.
SOURCE_TYPES = ("pdf", "html")
CONTENT_TYPES = ("api", "guide", "faq", "error", "tutorial")
PAGES = ("printed_page_start", "printed_page_end", "physical_page_start", "physical_page_end")
REQUIRED = ("source_id", "source_file", "section_path", "section_level", "node_ids", "chunk_id", "version", "product")
PAGE_OFFSET = -6
MIN_CHARS, MAX_CHARS, MAX_TOKENS = 20, 10_000, 1200

METADATA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("source_id", "source_file", "source_type", "part", "chapter", "section_path")]
    + [T.StructField("section_level", T.IntegerType())] + [T.StructField(n, T.IntegerType()) for n in PAGES]
    + [T.StructField("node_ids", T.ArrayType(T.StringType()))]
    + [T.StructField(n, T.StringType()) for n in ("chunk_id", "version", "product", "language", "platform", "content_type", "api_name", "error_code", "source_url", "title")]
)


def chunk_metadata(**values: Column) -> Column:
    """A metadata struct: given columns, defaults elsewhere, title from the section path."""
    defaults = {"version": F.lit("2.0"), "source_url": F.lit(""), "title": tx.last_segment(values["section_path"]) if "section_path" in values else F.lit(None)}
    fields = [values.get(f.name, defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in METADATA.fields]
    return F.struct(*fields)


def metadata_problems(m: str = "metadata") -> Column:
    """Array of the names of fields that are missing or not allowed."""
    c = lambda n: F.col(f"{m}.{n}")
    kind = c("source_type")
    missing = lambda n: c(n).isNull() | (c(n).cast("string") == "")
    checks = [F.when(~F.coalesce(kind.isin(*SOURCE_TYPES), F.lit(False)), F.lit("source_type"))]
    checks += [F.when(missing(n), F.lit(n)) for n in REQUIRED]
    checks += [F.when(missing(n) & ~kind.eqNullSafe(F.lit("html")), F.lit(n)) for n in ("part", "chapter")]
    checks += [F.when((kind == "pdf") & c(n).isNull(), F.lit(n)) for n in PAGES]
    checks += [F.when((kind == "html") & missing(n), F.lit(n)) for n in ("source_url", "title")]
    checks.append(F.when((F.coalesce(c("content_type"), F.lit("")) != "") & ~c("content_type").isin(*CONTENT_TYPES), F.lit("content_type")))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def page_problems() -> Column:
    """Problems of one page record (physical_page, printed_page, text, toc_entries)."""
    return F.filter(F.array(
        F.when(F.coalesce(F.col("physical_page") < 1, F.lit(True)), F.lit("physical_page")), F.when(F.col("printed_page") < 1, F.lit("printed_page")),
        F.when(F.col("text").isNull(), F.lit("text")), F.when(F.col("toc_entries").isNull(), F.lit("toc_entries")),
    ), lambda x: x.isNotNull())


def sequence_gaps(df: DataFrame, value: str, seq: str, *, group: str | None = None) -> DataFrame:
    """Missing numbers between a group's first and last row in the order of ``seq``."""
    keys = [group] if group else []
    ends = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, seq).alias("_a"), F.max_by(value, seq).alias("_b"))
    wanted = ends.filter("_a <= _b").select(*keys, F.explode(F.sequence("_a", "_b")).alias(value))
    return wanted.join(df.select(*keys, value), [*keys, value], "left_anti")


def inconstant_delta(df: DataFrame, a: str, b: str, seq: str, group: str) -> DataFrame:
    """Rows whose ``b - a`` isn't that of the group's first row with both; the reference row is an aggregate, no window."""
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("delta", F.col(b) - F.col(a))
    first = rows.groupBy(group).agg(F.min_by("delta", seq).alias("first_delta"))
    return rows.join(first, group).filter("delta <> first_delta")


def node_violations(nodes: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(chunk_id, rule) of every broken rule of the node-set contract.

    ``nodes`` is a chunk table with ``seq``; ``sources`` (source_id, version) are the registered ones.
    """
    rule = lambda df, name: df.select("chunk_id", F.lit(name).alias("rule"))
    out = rule(nodes.filter(F.coalesce(F.col("chunk_id") == "", F.lit(True))), "chunk_id_missing")
    again = nodes.groupBy("chunk_id").agg(F.count("*").alias("n")).filter("n > 1 AND chunk_id <> ''")
    out = out.union(rule(again, "chunk_id_repeated")).union(rule(nodes.filter(tx.is_blank(F.col("text"))), "text_blank"))
    out = out.union(nodes.select("chunk_id", F.explode(metadata_problems()).alias("p")).select("chunk_id", F.concat(F.lit("metadata:"), "p")))
    if sources is not None:
        known = nodes.select("chunk_id", F.col("metadata.source_id").alias("source_id"), F.col("metadata.version").alias("v")).join(sources.withColumn("_known", F.lit(True)), "source_id", "left")
        out = out.union(rule(known.filter("_known IS NULL"), "source_unregistered")).union(rule(known.filter("version <> '' AND NOT (v <=> version)"), "version_mismatch"))
    flat = nodes.select("chunk_id", "seq", F.col("metadata.source_id").alias("source"), F.col("metadata.physical_page_start").alias("pp"), F.col("metadata.printed_page_start").alias("pr"))
    return out.union(rule(inconstant_delta(flat, "pp", "pr", "seq", "source"), "page_delta"))


def quality_counters(nodes: DataFrame, *, text: str = "text", n_tokens: Column | None = None, least: int = MIN_CHARS, most: int = MAX_CHARS) -> DataFrame:
    """One row of counters over chunks; empty, short and long exclude each other."""
    body = tx.strip(F.coalesce(F.col(text), F.lit("")))
    tokens = F.size(tx.terms(F.col(text))) if n_tokens is None else n_tokens
    fences = F.size(F.split(F.col(text), "```", -1)) - 1
    rows = nodes.select(F.col(text).alias("t"), F.length(body).alias("n"), tokens.alias("tokens"), (fences % 2).alias("open_fence"), body.alias("b"))
    numbers = F.size(F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"^\s*\d{1,4}\s*$")))
    return rows.agg(
        F.count("*").alias("total"), F.count_if(F.col("n") == 0).alias("empty"), F.count_if((F.col("n") > 0) & (F.col("n") < least)).alias("short"), F.count_if(F.col("n") > most).alias("long"),
        F.count_if(F.col("tokens") > MAX_TOKENS).alias("over_tokens"), (F.count("t") - F.count_distinct("t")).alias("duplicates"), F.coalesce(F.sum(numbers), F.lit(0)).alias("page_number_lines"),
        F.count_if(F.col("open_fence") == 1).alias("broken_code"),
    )


def length_distribution(df: DataFrame, length: Column) -> DataFrame:
    """min, max, whole mean, p50 and p95 by linear interpolation."""
    return df.select(length.alias("n")).agg(F.min("n").alias("min"), F.max("n").alias("max"), F.floor(F.avg("n")).alias("mean"), F.floor(F.percentile("n", 0.5)).alias("p50"), F.floor(F.percentile("n", 0.95)).alias("p95"))


def rank_percentile(df: DataFrame, value: str, group: str, p: float) -> DataFrame:
    """(group, value at index round(p * (n - 1))): nearest rank; counted per value, so hot groups shrink first."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("c"))
    total = counts.groupBy(group).agg(F.sum("c").alias("n"))
    w = W.partitionBy(group).orderBy(value)
    running = counts.withColumn("upto", F.sum("c").over(w)).join(total, group)
    at = F.bround(F.lit(p) * (F.col("n") - 1))
    return running.filter((F.col("upto") > at) & (F.col("upto") - F.col("c") <= at)).select(group, F.col(value).alias("value"))


def repeated_rows(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, and the rows beyond the first."""
    return df.groupBy(*keys).agg((F.count("*") - 1).alias("extra")).filter("extra > 0")


def inspect(nodes: DataFrame, source_type: str = "source_type") -> DataFrame:
    """Per source type: nodes, repeated ids and texts, shortest, longest."""
    return nodes.groupBy(source_type).agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct("node_id")).alias("repeated_ids"), (F.count("*") - F.count_distinct("text")).alias("repeated_texts"), F.min(F.length("text")).alias("shortest"), F.max(F.length("text")).alias("longest"))


def category_counts(cases: DataFrame, categories: list[str]) -> DataFrame:
    """Cases per category, also those without any."""
    known = cases.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    return known.join(cases.groupBy("category").count(), "category", "left").select("category", F.coalesce("count", F.lit(0)).alias("n"))


def case_problems(cases: DataFrame, categories: list[str], prefix: str) -> DataFrame:
    """(id, problem) of cases: unknown category, wrong prefix, blank question, repeated id."""
    checks = F.array(F.when(~F.col("category").isin(*categories), F.lit("category")), F.when(~F.col("id").startswith(prefix), F.lit("prefix")), F.when(tx.is_blank(F.col("question")), F.lit("question")))
    rows = cases.select("id", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("problem"))
    return rows.union(cases.groupBy("id").count().filter("count > 1").select("id", F.lit("repeated_id")))
