"""Readers with explicit schemas, and the tolerant loaders around them."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import numeric, text as tx
from ..operators.html import EXCLUDED_DIRS, EXCLUDED_SUFFIX, INDEX_PAGES

PAGE = "physical_page int, printed_page int, text string, toc_entries array<struct<level:int,title:string,physical_page:int>>"
NODE = "node_id string, chunk_id string, text string, metadata map<string,string>"
QUESTION = "id string, question string, type string, version string, difficulty string"
CASE = "id string, category string, question string, chunks array<struct<source_id:string,source_name:string,source_type:string,version:string,section:string,page_print:int,text:string>>, gold_behavior string, gold_note string"
ABSTENTION = "id string, category string, question string, note string"


def jsonl(spark: SparkSession, path: str, schema: str, *, strict: bool = True, multi_line: bool = False) -> DataFrame:
    """JSON lines under a schema; ``strict`` fails on a bad line, else bad lines are left out."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def pages(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, PAGE)


def printed_pages(raw: DataFrame, offset: int = -6) -> DataFrame:
    """``raw`` (physical_page, text) with printed_page, from the header or by offset, and anomaly where they differ."""
    seen, rule = tx.printed_page(F.col("text")), F.when(F.col("physical_page") + offset >= 1, F.col("physical_page") + offset)
    return raw.withColumn("printed_page", F.coalesce(seen, rule)).withColumn("anomaly", F.coalesce(seen != rule, F.lit(False)))


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, physical_page, text) of PDF files; one file is read by one task. Needs the package pypdf on the workers."""
    import pyarrow as pa

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(batches):
        import io

        import pypdf

        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                texts = [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(content)).pages]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(texts)), pa.array(range(1, len(texts) + 1), pa.int32()), pa.array(texts)], ["path", "physical_page", "text"])

    return files.mapInArrow(run, "path string, physical_page int, text string")


def html_files(spark: SparkSession, path: str, *, sources: bool = False, index_pages: bool = True) -> DataFrame:
    """(path, file_name, html) of HTML files below ``path``, by path; listings and static folders are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").option("recursiveFileLookup", True).load(path)
    return html_filter(files.select("path", F.decode("content", "UTF-8").alias("html")), sources=sources, index_pages=index_pages)


def html_filter(files: DataFrame, *, sources: bool = False, index_pages: bool = True) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.withColumn("file_name", name)
    rows = rows.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, EXCLUDED_DIRS))))
    if not sources:
        rows = rows.filter(~F.col("file_name").endswith(EXCLUDED_SUFFIX))
    return rows if index_pages else rows.filter(~F.col("file_name").rlike(INDEX_PAGES))


def nodes(spark: SparkSession, path: str, *, strict: bool = True) -> DataFrame:
    """Nodes with the first id that is there: node_id, chunk_id, the metadata's."""
    rows = jsonl(spark, path, NODE, strict=strict)
    named = F.coalesce(F.nullif("node_id", F.lit("")), F.nullif("chunk_id", F.lit("")), F.col("metadata")["chunk_id"], F.lit(""))
    rows = rows.withColumn("node_id", named)
    return rows if strict else rows.filter("node_id <> ''")


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line) of lines that aren't JSON objects; blank lines are none."""
    rows = spark.read.text(path).select(F.input_file_name().alias("path"), F.col("value").alias("line"))
    return rows.filter(~tx.is_blank(F.col("line")) & F.coalesce(F.json_object_keys("line").isNull(), F.lit(True)))


def questions(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """Questions with id and text; an empty set is an error."""
    rows = jsonl(spark, path, QUESTION).filter(~tx.is_blank(F.col("id")) & ~tx.is_blank(F.col("question")))
    if rows.isEmpty():
        raise ValueError(f"no questions in {path}")
    return rows if first is None else rows.orderBy("id").limit(first)


def expected_sources(spark: SparkSession, path: str) -> DataFrame:
    """Annotations with page_lo and page_hi from a page, an interval or null; rows without any condition are left out."""
    raw = spark.read.text(path).filter(~tx.is_blank(F.col("value")))
    get = lambda n: F.nullif(F.get_json_object("value", f"$.{n}"), F.lit(""))
    spec = F.get_json_object("value", "$.page_print")
    rows = raw.select(get("question_id").alias("question_id"), get("source_id").alias("source_id"), numeric.page_bounds(spec).alias("p"), F.coalesce(spec.rlike(r"^-?\d+$"), F.lit(False)).alias("page_is_scalar"), get("section_keyword").alias("section_keyword"), get("source_url").alias("source_url"))
    rows = rows.select("question_id", "source_id", F.col("p.lo").alias("page_lo"), F.col("p.hi").alias("page_hi"), "page_is_scalar", "section_keyword", "source_url")
    return rows.filter("question_id IS NOT NULL AND coalesce(source_id, section_keyword, source_url, string(page_lo)) IS NOT NULL")


def artifacts(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(urls, details, counts per source) of a node table."""
    get = lambda n: F.col("metadata")[n]
    flat = rows.select("node_id", "text", get("source_id").alias("source_id"), get("source_url").alias("source_url"), get("version").alias("version"))
    counts = flat.groupBy("source_id").agg(F.count("*").alias("n"), F.min_by("version", F.when(F.col("version").isNotNull(), F.col("node_id"))).alias("version")).orderBy("source_id")
    return flat.filter("source_url <> ''").select("node_id", "source_url"), flat, counts


def hydrate(log: DataFrame, capacity: int) -> DataFrame:
    """The last record of each of the ``capacity`` request ids that came last: value by last write, age by first."""
    rows = log.groupBy("request_id").agg(F.max_by("record", "seq").alias("record"), F.min("seq").alias("first_seq"))
    return rows.orderBy(F.desc("first_seq")).limit(capacity)


def first_pages(hits: DataFrame) -> DataFrame:
    """(qid, page) of first hits with a page."""
    return hits.filter("rank = 1 AND page_print IS NOT NULL").select("qid", F.col("page_print").alias("page"))


def first_of(tables: list[DataFrame], key: str) -> DataFrame:
    """Union of tables in order of preference, the first row of each key."""
    rows = None
    for n, t in enumerate(tables):
        part = t.withColumn("_n", F.lit(n))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy("_n"))).filter("_r = 1").drop("_n", "_r")


@dataclass
class Experiment:
    """Settings of a run; unknown keys, modes and metrics are errors."""

    name: str
    mode: str = "bm25"
    top_k: int = 5
    candidate_top_k: int = 30
    rrf_k: int = 60
    chunking: str = "structure"
    metrics: list[str] = field(default_factory=lambda: ["hit_rate@5", "mrr@5"])
    prefer_version: str | None = None
    version_boost: float = 0.0

    def __post_init__(self) -> None:
        if self.mode not in ("bm25", "vector", "hybrid", "hybrid_rerank"):
            raise ValueError(f"{self.name}: unknown mode {self.mode!r}")
        if self.mode == "hybrid_rerank" and self.candidate_top_k < self.top_k:
            raise ValueError(f"{self.name}: the pool is smaller than top_k")
        for m in self.metrics:
            metric_name(m)

    @classmethod
    def from_dict(cls, values: dict) -> Experiment:
        import difflib

        known = [f.name for f in fields(cls)]
        for k in values:
            if k not in known:
                near = difflib.get_close_matches(k, known, 1)
                raise ValueError(f"unknown key {k!r}" + (f"; meant {near[0]!r}?" if near else ""))
        return cls(**values)


def metric_name(name: str) -> tuple[str, int]:
    kind, _, k = name.partition("@")
    if kind not in ("hit_rate", "mrr", "precision", "recall") or not k.isdigit():
        raise ValueError(f"unknown metric {name!r}")
    return kind, int(k)


def experiments(folder: str) -> list[str]:
    """Names of the experiments in a folder of settings, sorted."""
    return sorted(p.stem for p in Path(folder).glob("*.json"))
