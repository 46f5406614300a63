"""How the tables at hand stand for nodes, questions, expectations, pages and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sized import sized_broadcast


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as nodes; the language stands for a version."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), "text", F.col("source").alias("source_id"), F.col("source").alias("source_name"), F.col("lang").alias("version"), F.lit("html").alias("source_type"), F.concat("lang", F.lit(" / "), "source").alias("section"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected nodes: documents that hold an item's text."""
    return holders(questions(spark, sf_dir), nodes(spark, sf_dir))


def holders(asked: DataFrame, held: DataFrame) -> DataFrame:
    """(qid, node_id) of nodes whose text contains a question's text as written.

    What stands between two blanks of a question also stands between two blanks of a text that
    contains it: the longest such piece is an anchor, and only texts with the anchor are searched.
    Questions without an anchor are searched in every text.
    """
    inner = F.array_sort(F.transform(F.slice(F.split("question", " ", -1), 2, F.greatest(F.size(F.split("question", " ", -1)) - 2, F.lit(0))), lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p"))))
    q = asked.select("qid", "question", F.get(inner, 0)["p"].alias("anchor"))
    pieces = held.select("node_id", "text", F.explode(F.array_distinct(F.split("text", " ", -1))).alias("anchor"))
    found = pieces.join(sized_broadcast(q.filter("anchor IS NOT NULL")), "anchor").filter(F.contains("text", "question")).select("qid", "node_id")
    rest = q.filter("anchor IS NULL AND question IS NOT NULL")
    if rest.limit(1).count():
        found = found.union(held.join(sized_broadcast(rest), F.contains("text", "question")).select("qid", "node_id"))
    return found.distinct()


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding", "label")


def vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th vector asks."""
    return vectors(spark, sf_dir).filter("node_id % 50 = 0").select(F.col("node_id").alias("qid"), F.col("embedding").alias("q"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as pages (doc, physical_page, printed_page, text)."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
    return d.select("doc", (F.col("i") + 1).alias("physical_page"), F.when(F.col("i") >= 6, F.col("i") - 5).alias("printed_page"), "text")


def bookmarks(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Every line's first 40 characters as a bookmark whose level follows from its number."""
    rows = lines(spark, sf_dir) if rows is None else rows
    return rows.select("doc", F.col("physical_page").alias("seq"), F.col("physical_page").alias("page"), (F.col("physical_page") % 5 + 1).alias("level"), F.substring("text", 1, 40).alias("title"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as annotations: quality as first page, a fixed width, the first word as keyword."""
    x = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id")
    return x.select(F.col("doc_id").alias("question_id"), F.col("source").alias("source_id"), (F.col("quality") + 1).cast("int").alias("page_lo"), (F.col("quality") + 3).cast("int").alias("page_hi"), F.lit(False).alias("page_is_scalar"), F.substring_index("text", " ", 1).alias("section_keyword"))


def audited_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as nodes with page intervals."""
    d = read(spark, sf_dir, "documents")
    start = (F.col("doc_id") % 7 + 1).cast("int")
    return d.select("doc_id", F.col("source").alias("source_id"), F.col("doc_id").alias("ord"), "text", F.substring("text", 1, 20).alias("title"), F.concat("lang", F.lit(" / "), F.substring("text", 1, 20)).alias("section_path"), start.alias("printed_page_start"), (start + 1).alias("printed_page_end"))
