"""Registered queries of the operators in this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, language_id, near_dedup, oracles, quality_classifier, quality_rules, secrets, substring_dedup, suffix_dedup, url_filters
from .common import documents

#: host, path, verdict
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def _remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(_remainder(4) == 2, F.lit(False))
    model = language_id.fit(docs, ~held_out)
    df = language_id.identify(docs.select("doc_id", "text"), model, "doc_id")
    return df.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


#: Ranks file of the tokenizer, and the pattern that splits texts.
RANKS = "byte_bpe_multi_50k.tiktoken"


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokenizer = (public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    df = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), *tokenizer, decoded="decoded")
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return df.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.coalesce(_remainder(3) == 1, F.lit(False))
    model = quality_classifier.fit(docs, labels, ~held_out)
    df = quality_classifier.score(docs.select("doc_id", "text"), model, "doc_id")
    return df.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quality_rules.apply_rules(documents(spark, sf_dir), "doc_id")
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    df = url_filters.filter_urls(pages.select("page_id", "url"), url_filters.rule_table(spark, URL_RULES))
    return df.select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = """
WITH parsed AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
rules(rh, rp, rv) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
urls AS (SELECT DISTINCT host, path FROM parsed),
best AS (
  SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
  FROM urls JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY host, path)
SELECT page_id, p.host AS host, p.path AS path, rule, coalesce(rv, 'allow') AS verdict
FROM parsed p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
"""


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = substring_dedup.near_passages(documents(spark, sf_dir).select("doc_id", "text"), every=True)
    return df.select("doc_id", "class_id", "n_links", F.to_json("passages").alias("passages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contaminated(documents(spark, sf_dir), benchmark)


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = secrets.find_secrets(documents(spark, sf_dir), "doc_id")
    spans = F.col("secret_spans")
    base = F.filter(spans, lambda s: s["kind_no"] < 3)
    count = lambda n: F.size(F.filter(spans, lambda s: s["kind_no"] == n)).cast("long")
    return df.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.spans_text(base), 256).alias("base_sha256"), secrets.spans_text(spans).alias("spans"),
    )


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = suffix_dedup.remove_repeats(documents(spark, sf_dir), "doc_id", length=400)
    return df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = near_dedup.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), threshold=85)
    return df.select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_quality_rules": op4_quality_rules,
    "op5_url_filters": op5_url_filters,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_secret_scans": op8_secret_scans,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
}

ORACLES = {"op5_url_filters": OP5_SQL, **oracles.ORACLES}
