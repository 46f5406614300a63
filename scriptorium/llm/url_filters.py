"""URL filters: host-suffix and path-prefix expressions joined on short hash prefixes.

Each distinct URL is expanded into (host suffix + path prefix) expressions.  Expressions meet
the rules in an equi-join on the first 32 bits of their SHA-256; a hit counts only if the full
digest agrees.  Of a URL's hits the longest rule decides, then the longer host, then block.
Only DataFrame functions are used.

Defined cases: a null URL, or one without ``://``, has an empty host and path and fits no rule.
An empty path fits no rule whose path starts with ``/``.  Without a fitting rule the verdict is
``default`` (allow).  Repeated URLs and ids give one row per input row; extra columns of the
input are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small

#: Hex digits of the digest that the join uses.
PREFIX_DIGITS = 8


def host_of(url: Column) -> Column:
    tail = url.substr(F.instr(url, "://") + F.lit(3), F.length(url))
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(tail, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")


def path_of(url: Column) -> Column:
    tail = url.substr(F.instr(url, "://") + F.lit(3), F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_table(spark, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Rules (host, path, verdict) as a table with the digest of host and path."""
    names = ("rule_host", "rule_path", "rule_verdict")
    rows = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, rule, strict=True)]) for rule in rules]
    return with_digest(spark.range(1).select(F.inline(F.array(*rows).cast("array<struct<rule_host:string,rule_path:string,rule_verdict:string>>"))))


def with_digest(rules: DataFrame) -> DataFrame:
    """Adds digest, key and the numbers of host labels and path characters to a table of rules."""
    digest = F.sha2(F.concat("rule_host", F.lit("\0"), "rule_path"), 256)
    return rules.select(
        "rule_host", "rule_path", "rule_verdict", F.concat("rule_host", "rule_path").alias("rule"),
        digest.alias("rule_digest"), F.conv(F.substring(digest, 1, PREFIX_DIGITS), 16, 10).cast("long").alias("key"),
        F.size(F.split("rule_host", r"\.")).alias("n_labels"), F.length("rule_path").alias("n_path"),
    )


def filter_urls(pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict.

    ``rules`` comes from :func:`rule_table` or :func:`with_digest`.  Its distinct path lengths and
    its largest number of labels bound the expansion; no expression that a rule could equal is lost.
    """
    # lengths of rule paths: at most the longest URL has, never a row per rule
    bounds = rules.agg(F.max("n_labels"), F.array_sort(F.collect_set("n_path"))).first()
    labels, lengths = bounds[0] or 0, bounds[1] or []
    parsed = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    parsed = parsed.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    if not lengths:
        return parsed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    urls = parsed.select("host", "path").distinct()
    parts = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))),
        lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."),
    )
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(int(n)) for n in lengths]), lambda n: n <= F.length("path")),
        lambda n: F.col("path").substr(F.lit(1), n),
    )
    expressions = urls.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes))
    expressions = expressions.withColumn("digest", F.sha2(F.concat("suffix", F.lit("\0"), "prefix"), 256))
    expressions = expressions.withColumn("key", F.conv(F.substring("digest", 1, PREFIX_DIGITS), 16, 10).cast("long"))
    hits = expressions.join(small(rules), "key").filter(F.col("digest") == F.col("rule_digest"))
    order = F.struct(F.length("rule"), F.length("rule_host"), (F.col("rule_verdict") == "block").cast("int"), "rule", "rule_verdict")
    best = hits.groupBy("host", "path").agg(F.max(order).alias("best"))
    best = best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("verdict"))
    joined = parsed.drop("rule", "verdict").join(best, ["host", "path"], "left")
    return joined.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
