"""Corpus pipeline: documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that the stage
before kept, written as Parquet and read again.  All but the last return the columns of documents.
SQL can't express the learned, similarity and tokenizer stages, so ORACLE_SQL is None and the tests
compare run() with a plain Python version.

Defined cases, for every stage: a null or empty text is a text without words (it is scored, linked
with nothing, holds no benchmark item and no secret, and has no tokens); texts are never cut; rows
with equal ids count as one document where documents are compared, and stay as many rows where
rows are judged; rows with a null id are kept by near-dedup; ties go to the smallest id; other
columns pass through; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import bpe, decontaminate, near_dedup, quality_classifier, secrets
from scriptorium.llm.common import materialize, small
from scriptorium.llm.queries import RANKS

#: Rows of ids that are broadcast at most, to drop the documents that have them.
DROPPED_ROWS = 400_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good; it learns from two thirds of the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    usable = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 != 1, F.lit(False))
    model = quality_classifier.fit(docs, labels, usable)
    return quality_classifier.score(docs, model, *docs.columns).filter("predicted = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    found = near_dedup.near_duplicates(docs.select("doc_id", "text"), threshold=85)
    dropped = materialize(found.filter("NOT kept").select("doc_id").distinct(), "pipeline-dropped")
    return docs.join(small(dropped, DROPPED_ROWS), "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    found = secrets.find_secrets(docs, *docs.columns)
    text = F.when(F.col("text").isNotNull(), secrets.redact(F.col("text"), F.col("secret_spans")))
    found = found.withColumn("text", text).withColumn("n_chars", F.when(F.size("secret_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text again."""
    import public_tokenizers

    tokenizer = (public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    rows = docs.select("doc_id", "lang", "source", "text", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    rows = bpe.encode(rows, *tokenizer, decoded="decoded", forget=True)
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.md5("decoded") == F.col("digest")).alias("round_trip"))


STAGES = [
    ("quality classifier", quality),
    ("near-dedup", near_duplicates),
    ("decontamination", decontamination),
    ("secret scans", secret_scan),
    ("byte-level BPE", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
